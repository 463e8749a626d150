"""Column-level helpers: pure Catalyst expressions, usable inside whole-stage codegen."""
