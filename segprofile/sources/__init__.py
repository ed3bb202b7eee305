"""Reading tables in and writing reports out."""
