"""Reading and writing tables, and the retail roles of the test tables."""
