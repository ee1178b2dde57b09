"""Plan building blocks: schemas, samples, and mapping distinct values."""
