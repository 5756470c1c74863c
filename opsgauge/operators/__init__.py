"""Operators: functions that take and return DataFrames."""

# The parts of a key that say which server and database a metadata row is from.
SCOPE = ("server", "database_id")
OBJECT = (*SCOPE, "object_id")
INDEX = (*OBJECT, "index_id")
UNIT = (*INDEX, "partition_number")
