"""Operators: segmentation, chunks, tokens and n-grams, online predictors, entropy
and quantised tables as DataFrame plans; coder, codec and blobs as row kernels;
containers that join the two."""
