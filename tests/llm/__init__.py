"""A package, so that test_pipeline here and beside it are two modules."""
