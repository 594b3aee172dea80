"""Planning of date ranges, search, and the registered queries."""
