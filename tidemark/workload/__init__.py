"""The engine applied to the test tables, with the same questions asked in plain SQL."""
