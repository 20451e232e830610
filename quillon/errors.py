"""The error kinds of the engine; `status` is the HTTP-style code a front end would answer with."""

from __future__ import annotations


class EngineError(Exception):
    kind, status = "internal", 500


class CollectionNotFound(EngineError):
    kind, status = "collection_not_found", 404

    def __init__(self, name: str):
        super().__init__(f"no collection {name!r}")


class DocumentNotFound(EngineError):
    kind, status = "document_not_found", 404

    def __init__(self, doc_id: str):
        super().__init__(f"no document {doc_id!r}")


class SchemaConflict(EngineError):
    kind, status = "schema_conflict", 409

    def __init__(self, name: str):
        super().__init__(f"collection {name!r} exists with another mapping")


class MappingError(EngineError):
    kind, status = "mapping", 400


class ValidationError(EngineError):
    kind, status = "validation", 400


class RecoveryError(EngineError):
    kind, status = "recovery", 500


class WriterLost(EngineError):
    kind, status = "writer_lost", 503

    def __init__(self, root: str):
        super().__init__(f"another writer has opened the catalog {root!r}, or this one only reads")
