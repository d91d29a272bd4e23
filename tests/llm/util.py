"""Shared by the tests of the training-data operators."""

SF = "/root/testdata/sf0.001"
