"""Where the tests find the given tables."""

SF_SMALL = "/root/testdata/sf0.001"
