"""Errors of the store, one class for each condition a caller may handle."""


class StoreError(Exception):
    """Base of all errors raised here."""


def _error(name: str, says: str) -> type[StoreError]:
    return type(name, (StoreError,), {"__doc__": says, "__init__": lambda self, text=says: StoreError.__init__(self, text)})


NoID = _error("NoID", "the table has no ID field")
ZeroID = _error("ZeroID", "the record's ID is a zero value")
BadType = _error("BadType", "the value or column has a type that the operation does not take")
AlreadyExists = _error("AlreadyExists", "a record with this unique value exists")
NilParam = _error("NilParam", "a value is required")
UnknownTag = _error("UnknownTag", "unknown field tag")
IndexNotFound = _error("IndexNotFound", "the table has no such index")
NoName = _error("NoName", "the table has no name")
NotFound = _error("NotFound", "no record was found")
NotInTransaction = _error("NotInTransaction", "not in a transaction")
ReadOnly = _error("ReadOnly", "the transaction is read-only")
IncompatibleValue = _error("IncompatibleValue", "the value does not fit the field")
DifferentCodec = _error("DifferentCodec", "the bucket was written with another codec")
Conflict = _error("Conflict", "another writer committed first")
UnsupportedSQL = _error("UnsupportedSQL", "this SQL is not supported")
SQLTableNotRegistered = _error("SQLTableNotRegistered", "the SQL table is not known")
SQLUnknownField = _error("SQLUnknownField", "the SQL field is not known")
SQLBadProjection = _error("SQLBadProjection", "the projection does not fit its target")
SQLArguments = _error("SQLArguments", "the number of arguments differs from the number of placeholders")
SQLUnsafeWrite = _error("SQLUnsafeWrite", "UPDATE or DELETE without WHERE")
UnknownField = _error("UnknownField", "the field is not known")
