"""Local search and learners; everything here runs inside one Spark task."""
