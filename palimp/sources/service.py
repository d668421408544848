"""The service of publications: searches, histories, details and files, over a transport that a caller may replace.

A transport is called with (path, parameters, timeout) and returns a decoded answer, or bytes for a file; it raises HttpError,
TimeoutError or ConnectionError. Pace and retries are the client's.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from palimp.sources.paged import COUNT, PACE, RETRIES, Client, HttpError, route

Transport = Callable[[str, dict, float], "dict | bytes"]
#: The service's paths, and how many listings a page of a history has.
SEARCH, DETAIL, FILE, LISTINGS = "bulario", "medicamento/produtos/codigo", "medicamentos/arquivo/bula/parecer", 500


def http(base: str, env: dict[str, str] | None = None) -> Transport:
    """A transport over HTTP, through the proxy that the environment names, if any."""
    import urllib.error
    import urllib.parse
    import urllib.request
    from http.client import HTTPException

    address, extra = route(base, dict(os.environ) if env is None else env)

    def ask(path: str, params: dict, timeout: float) -> dict | bytes:
        query = urllib.parse.urlencode(params)
        request = urllib.request.Request(f"{address}/{path}" + (f"?{query}" if query else ""), headers={"accept": "application/json", **extra})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                body = answer.read()
        except urllib.error.HTTPError as e:
            raise HttpError(e.code, e.headers.get("Retry-After")) from e
        except (urllib.error.URLError, HTTPException) as e:
            raise ConnectionError(str(e)) from e
        if path.startswith(FILE):
            return body
        try:
            return json.loads(body)
        except ValueError as e:  # an answer that was cut off
            raise ConnectionError(f"{path}: no whole answer") from e

    return ask


class Service:
    """One caller of a service: requests one after the other, at its pace, tried again as the client's rules say."""

    def __init__(self, transport: Transport, pace: float = PACE, retries: int = RETRIES, late: float = 0.0, **client) -> None:
        self.client = Client(lambda p, timeout: transport(p["path"], p["params"], timeout), pace, retries, late=late, **client)

    def ask(self, path: str, **params) -> dict | bytes:
        return self.client.page(path=path, params=params)

    def search(self, page: int = 1, count: int = COUNT, **filters: str) -> dict:
        return self.ask(SEARCH, count=count, page=page, **{f"filter[{k}]": v for k, v in filters.items()})

    def found(self, count: int = COUNT, **filters: str) -> Iterator[dict]:
        """All rows of a search."""
        page, more = 1, True
        while more:
            answer = self.search(page, count, **filters)
            yield from answer["content"]
            page, more = page + 1, not answer.get("last", True)

    def history(self, product: int, limit: int | None = None) -> dict:
        """The listings of a product, newest first: the first `limit`, or all."""
        answer = self.ask(f"{SEARCH}/{product}", count=limit or LISTINGS)
        if limit is None:
            for page in range(2, answer["historico"].get("totalPages", 1) + 1):
                answer["historico"]["content"] += self.ask(f"{SEARCH}/{product}", page=page, count=LISTINGS)["historico"]["content"]
        return answer

    def detail(self, product: int) -> dict:
        return self.ask(f"{DETAIL}/{product}")

    def file(self, name: str) -> bytes:
        return self.ask(f"{FILE}/{name}/", Authorization="")
