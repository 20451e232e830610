"""A front end with the verbs and answer shapes of a document service, over a Catalog; no server."""

from __future__ import annotations

import json
from dataclasses import dataclass

from quillon.errors import EngineError, ValidationError
from quillon.mapping import ID, SOURCE, Mapping
from quillon.operators.search import LIMIT, OFFSET
from quillon.sources.catalog import Catalog

MAX_BODY = 4 << 20


@dataclass(frozen=True)
class Answer:
    status: int
    body: dict | None = None


def answered(call):
    """Errors of the engine as answers."""

    def run(*args, **kwargs) -> Answer:
        try:
            return call(*args, **kwargs)
        except EngineError as e:
            return Answer(e.status, {"error": {"kind": e.kind, "message": str(e)}})

    run.__doc__ = call.__doc__
    return run


class Engine:
    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    @staticmethod
    def health() -> Answer:
        return Answer(200, {"status": "ok"})

    @answered
    def list_collections(self) -> Answer:
        return Answer(200, {"collections": self.catalog.list()})

    @answered
    def create_collection(self, name: str, body: str) -> Answer:
        """201 if created, 200 if it was there with an equal mapping."""
        return Answer(201 if self.catalog.create(name, Mapping.from_json(body)) else 200)

    @answered
    def describe_collection(self, name: str) -> Answer:
        return Answer(200, json.loads(self.catalog.describe(name).to_json()))

    @answered
    def drop_collection(self, name: str) -> Answer:
        self.catalog.drop(name)
        return Answer(204)

    def _body(self, body: str) -> str:
        if len(body.encode()) > MAX_BODY:
            raise ValidationError(f"a body is at most {MAX_BODY} bytes")
        return body

    @answered
    def post_document(self, name: str, body: str) -> Answer:
        """A new id; always 201 and created."""
        doc_id, _ = self.catalog.upsert(name, self._body(body))
        return Answer(201, {"id": doc_id, "result": "created"})

    @answered
    def put_document(self, name: str, doc_id: str, body: str) -> Answer:
        """201 created or 200 updated, as the committed view has it."""
        _, created = self.catalog.upsert(name, self._body(body), doc_id)
        return Answer(201 if created else 200, {"id": doc_id, "result": "created" if created else "updated"})

    @answered
    def get_document(self, name: str, doc_id: str, fresh: bool = False) -> Answer:
        return Answer(200, {"id": doc_id, "source": json.loads(self.catalog.get(name, doc_id, fresh))})

    @answered
    def delete_document(self, name: str, doc_id: str) -> Answer:
        self.catalog.delete(name, doc_id)
        return Answer(204)

    @answered
    def search_documents(self, name: str, q: str = "", limit: int = LIMIT, offset: int = OFFSET) -> Answer:
        found = self.catalog.search(name, q, limit, offset)
        hits = [{"id": r[ID], "score": r["score"], "source": json.loads(r[SOURCE])} for r in found.hits.collect()] if limit else []
        return Answer(200, {"hits": hits, "total": found.total})
