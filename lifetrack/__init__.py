"""Movement and life-history analytics over entity - location - period tables, on PySpark."""
