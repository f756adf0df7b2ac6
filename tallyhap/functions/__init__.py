"""Column functions: CIGAR arithmetic, chromosome names, alleles, VCF and GTF fields."""
