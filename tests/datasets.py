"""Where the given tables lie, for every test module."""
SF_SMALL = "/root/testdata/sf0.001"
