"""Training-data operators: ten independent operators, their queries and their SQL twins.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""
