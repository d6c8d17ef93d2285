"""Places that all machines see."""

from __future__ import annotations

import uuid


def shared(spark) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset, as in tests, one below the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints").rstrip("/")


def scratch(spark, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


_built: dict = {}


def once(spark, key: tuple, build) -> str:
    """The path that build(path) has filled for this key; built again only by another application."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _built:
        path = scratch(spark, str(key[1]))
        build(path)
        _built[key] = path
    return _built[key]
