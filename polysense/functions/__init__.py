"""Column builders and the small numpy kernels used inside Arrow tasks."""
