"""Plan builders shared by the operators: size checks, order without one partition, quantiles."""
