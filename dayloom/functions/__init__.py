"""Column expressions and the small numpy kernels used inside tasks."""
