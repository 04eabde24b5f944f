"""Column-level functions; none of them triggers a job."""
