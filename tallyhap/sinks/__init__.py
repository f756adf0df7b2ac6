"""Writers of matrices, variants, regions and genes."""
