"""Table schemas and sentinel values."""

from pyspark.sql import types as T


def _of(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns])


_L, _S, _B, _TS = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampType()

PROJECTS = _of(("project_id", _L), ("project_root", _S))
FILEPATHS = _of(("project_id", _L), ("filepath_id", _L), ("filepath", _S), ("create_time", _TS))
DEFINITIONS = _of(("project_id", _L), ("func_def_id", _L), ("create_time", _TS), ("usr", _S), ("qualified", _S), ("might_throw", _B), ("location_file_id", _L), ("location_line", _L))
CALLS = _of(("project_id", _L), ("func_call_id", _L), ("create_time", _TS), ("caller_usr", _S), ("caller_might_throw", _B), ("usr", _S), ("qualified", _S), ("location_file_id", _L), ("location_line", _L))
#: One row for each symbol occurrence, as an extractor writes them.
OCCURRENCES = _of(("tu", _S), ("tu_ok", _B), ("kind", _S), ("is_decl", _B), ("is_def", _B), ("is_macro", _B), ("is_builtin", _B), ("usr", _S), ("qualified", _S), ("container_usr", _S), ("container_kind", _S), ("file", _S), ("line", _L), ("might_throw", _B))
TABLES = {"projects": PROJECTS, "filepaths": FILEPATHS, "func_definitions": DEFINITIONS, "func_calls": CALLS}

# Fixed values.
FUNCTION_KINDS = ("Function", "CXXMethod", "Constructor", "Destructor", "Conversion")
MACRO_PREFIX = "@macro@"
INVALID_FILE_ID = -1
LONGEST_PATH, LONG_PATH = 2048, "FILE_PATH_TOO_LONG"
IGNORED_EXCEPTIONS = ("AssertionError",)
BAD_ALLOC = "std::bad_alloc"
COMPILERS = ("clang", "clang++")
