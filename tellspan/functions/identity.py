"""The entity that a resource describes, by its identifying attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed ladder: required keys, then optional ones. The first full match names the entity.
LADDER = (
    (("service.name", "service.instance.id"), ("service.namespace",)),
    (("k8s.pod.uid",), ("k8s.container.name",)),
    (("container.id",), ()),
    (("host.id",), ("process.pid",)),
    (("host.name",), ("process.pid",)),
    (("service.name",), ("service.namespace",)),
)


def _first(attrs: Column, key: str) -> Column:
    """The first entry of a key, whatever its value."""
    return F.get(F.filter(attrs, lambda x: x["key"] == key), 0)


def entity_key(resource: Column | str) -> Column:
    """``rung|key=type:value|…``, or null where no rung matches. Other attributes and their order don't matter.

    Types are part of the key, so 1 and "1" are different entities. The key is text rather than a
    hash: equality is all that it is used for, and it needs no Python.
    """
    col = F.col(resource) if isinstance(resource, str) else resource
    rungs = []
    for n, (required, optional) in enumerate(LADDER, 1):
        found = {k: _first(col, k) for k in (*required, *optional)}
        text = {k: F.concat(F.lit(f"|{k}="), v["type"].cast("string"), F.lit(":"), F.coalesce(v["s"], v["i"].cast("string"), v["d"].cast("string"), v["b"].cast("string"), F.hex(v["bytes"]), v["json"], F.lit(""))) for k, v in found.items()}
        whole = F.lit(True)
        for k in required:
            whole = whole & found[k].isNotNull()
        rungs.append(F.when(whole, F.concat(F.lit(str(n)), *(text[k] for k in required), *(F.coalesce(text[k], F.lit("")) for k in optional))))
    return F.coalesce(*rungs)
