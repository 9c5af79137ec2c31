"""Training-data operations: dedup, token counts, scoring, search, mixing and packing.

Nothing outside this folder imports it. Each module holds one operation with its own
interface; ``queries`` binds them to the tables and to fixed output columns.
"""
