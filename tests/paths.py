"""Test data folders (imported by name; no test module imports a conftest)."""

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
