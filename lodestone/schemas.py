"""The data model as Spark types. Recursive records are adjacency tables (id, parent_id, depth)."""

from __future__ import annotations

FILE_NODE = "file_name string, upper_path string, module string, define_class array<string>, imports array<string>"
CODE_NODE = f"start_line int, end_line int, belongs_to struct<{FILE_NODE.replace(' string', ':string').replace(' array', ':array')}>, relative_function array<string>, code string"
_CODE = "struct<start_line:int,end_line:int,belongs_to:struct<file_name:string,upper_path:string,module:string,define_class:array<string>,imports:array<string>>,relative_function:array<string>,code:string>"
QA_PAIR = f"question string, answer string, relative_code_list array<{_CODE}>, ground_truth string, score double"
EVALUATION = "score int, reasoning string"
EVALUATION_RESULT = "question string, answer string, score int, reasoning string, suggestions array<string>"
RESULT_PAIR = "answer string, ground_truth string, thought string"
DECOMPOSITION = "`sub-questions` array<struct<description:string,answer:string,dependencies:array<int>>>, answer string"

FILES = "file string, pos long, module string, define_class array<string>, imports array<string>, error string"
CLASSES = "file string, pos long, name string, docstring string, code string, start_line int, end_line int, bases array<string>"
FUNCTIONS = "file string, pos long, name string, class_name string, is_method boolean, docstring string, code string, start_line int, end_line int, parameters array<string>, calls array<string>"
ATTRIBUTES = "file string, pos long, name string, class_name string, type_hint string"
VARIABLES = "file string, pos long, name string, scope string, function_name string, class_name string, value string, is_constant boolean"
BLOCKS = "file string, ord int, parent_ord int, depth int, path array<string>, type string, identifier string, content string, start_line int, end_line int, tokens int"
SPANS = "file string, span_id string, span_type string, start_line int, end_line int, tokens int, ord int"
CONTEXT = "node_id long, file_path string, pos int, span_id string, pinned boolean, tokens int"
NODES = "node_id long, parent_id long, visits long, value double, reward double, action string, args string, is_terminal boolean, is_duplicate boolean, max_expansions int"
MODULES = "module_id string, parent_id string, depth int, name string, is_package boolean"
EDGES = "source_type string, source_id string, target_type string, target_id string, relationship_type string"

#: Block types and their groups.
BLOCK_TYPES = {
    "module": "structure", "class": "structure", "function": "structure", "constructor": "structure", "test_suite": "structure", "test_case": "structure",
    "import": "import", "export": "import", "comment": "comment", "commented_out_code": "comment",
    "assignment": "implementation", "call": "implementation", "code": "implementation", "statement": "implementation", "block": "implementation", "compound": "implementation", "dependent_clause": "implementation",
    "space": "space", "error": "error",
}


def checked(df, column: str, low: float, high: float):
    """(rows within the range, the others): invalid rows are set aside, not fatal."""
    inside = f"coalesce({column} between {low} and {high}, false)"
    return df.where(inside), df.where(f"not {inside}")
