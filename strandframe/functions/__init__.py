"""Column functions: they only build expressions and never trigger a job."""
