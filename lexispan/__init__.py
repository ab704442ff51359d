"""Lexical data engine on Spark: layout and line parsing, cleaning, repair, profiling and ranked search."""
