"""Names and schemas of statements, the rows that everything on graphs works on.

A statement is subject, predicate and object with qualifiers. Nodes are resources (a full URI), blank nodes (a
surrogate, see normalize) or literals (a value); record_id is the resource that a blank node belongs to, and what
belongs to a record is found by it without recursion. Validity is half open, in versions of the model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

RESOURCE, BNODE, LITERAL, TYPE_RESOURCE, TYPE_BNODE = "RESOURCE", "BNODE", "LITERAL", "TYPE_RESOURCE", "TYPE_BNODE"

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"
RDF_VALUE = RDF + "value"

#: A column that statements and types may have besides: a number that is the same for all statements of a record and for all
#: that name one blank node or have one key. Rows that come spread by it (session.colocated) are grouped and joined where they are.
HOME = "home"
#: Between the predicates of an attribute path.
PATH_SEP = "\u001e"
#: valid_to of a statement that holds.
OPEN_END = 2147483647
#: The model of statements that were written without one.
DEFAULT_MODEL = ""
#: The longest chain of blank nodes that is followed.
DEPTH = 20

RAW = (
    "model string, record_id string, pos bigint, subject_kind string, subject_id string, predicate string,"
    " object_kind string, object_id string, object_value string, ord bigint, evidence string, confidence string, uuid string"
)
RAW_COLUMNS = [c.split()[0] for c in RAW.split(",")]
STATEMENT = (
    "model string, record_id string, idx bigint, subject_kind string, subject_id string, predicate string, object_kind string,"
    " object_id string, object_value string, ord bigint, evidence string, confidence string, stmt_uuid bigint, stmt_key string,"
    " valid_from int, valid_to int"
)
STATEMENT_COLUMNS = [c.split()[0] for c in STATEMENT.split(",")]
NODE_TYPE = "model string, node_id string, node_kind string, type_uri string, pos bigint, record_id string"
NODE_TYPE_COLUMNS = [c.split()[0] for c in NODE_TYPE.split(",")]
MODEL_VERSION = "model string, latest_version int"


def homed(*tables: DataFrame) -> list[str]:
    """The column HOME, if all tables have it, to be put before the keys that they are grouped or joined by."""
    return [HOME] if all(HOME in t.columns for t in tables) else []
