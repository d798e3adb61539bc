"""Query builder, finders and write operators."""
