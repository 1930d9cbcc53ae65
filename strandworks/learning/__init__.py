"""A convolutional classifier trained by many tasks at once, and weighted draws of its examples."""
