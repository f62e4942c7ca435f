"""The registered queries, their oracle statements and the tables they share."""

from checks import (  # noqa: F401
    contest,
    fields,
    files,
    flagship,
    history,
    models,
    money,
    pages,
    relations,
    whole,
)
from checks.registry import ORACLES, QUERIES  # noqa: F401
