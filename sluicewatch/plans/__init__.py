"""Plan shapes shared by operators, and reports put together from them."""
