"""Table transformations, DataFrame in and DataFrame out."""
