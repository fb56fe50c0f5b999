"""Input folders of the tests (a plain module: conftest modules of several folders share one name)."""

SF_SMALL = "/root/testdata/sf0.001"
