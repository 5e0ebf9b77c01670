"""Jobs over collections of query plans held as node and edge tables."""
