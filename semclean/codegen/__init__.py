"""Generated Python: cleaning up its source, compiling it in a restricted namespace, applying it to Arrow batches."""
