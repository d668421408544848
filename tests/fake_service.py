"""A service of 25 made-up rows, for tests and trials of the paged source."""

from __future__ import annotations

import os
import time


def timed(params: dict, timeout: float) -> dict:
    """fetch(), noting when it was asked in the file that PALIMP_ASKED names."""
    with open(os.environ["PALIMP_ASKED"], "a") as f:
        f.write(f"{time.time()}\n")
    return fetch(params, timeout)


def fetch(params: dict, timeout: float) -> dict:
    rows = [{"numeroRegistro": str(i), "idProduto": i, "cnpj": "x" if i % 2 else "y"} for i in range(25)]
    rows = [r for r in rows if params.get("cnpj") in (None, r["cnpj"])]
    size, n = params["count"], params["page"]
    return {"content": rows[(n - 1) * size : n * size], "totalPages": -(-len(rows) // size), "totalElements": len(rows), "last": n * size >= len(rows), "number": n}


def days(params: dict, timeout: float) -> dict:
    """Two publications a day from 2024-01-01 to 2024-01-12, one of them of a key that comes every fourth day again."""
    first, last = params["periodoPublicacaoInicial"], params["periodoPublicacaoFinal"]
    rows = []
    for d in range(1, 13):
        day = f"2024-01-{d:02d}"
        if first <= day <= last:
            rows += [{"numeroRegistro": str(d), "expediente": "new", "data": f"{day}T10:00"}, {"numeroRegistro": str(100 + d % 4), "expediente": "again", "data": f"{day}T09:00"}]
    size, n = params["count"], params["page"]
    return {"content": rows[(n - 1) * size : n * size], "last": n * size >= len(rows)}


def _state(change=None) -> dict:
    """What the service remembers between requests, in the file that PALIMP_SERVICE names."""
    import json

    path = os.environ["PALIMP_SERVICE"]
    with open(path) as f:
        state = json.load(f)
    if change:
        change(state)
        with open(path, "w") as f:
            json.dump(state, f)
    return state


def product_service(path: str, params: dict, timeout: float) -> dict | bytes:
    """Products 100, 200 and 300. Each history gives new ids; older ids have run out. 200 has no detail, one of its files is lost; 300 has an odd file."""
    from palimp.sources.paged import HttpError

    asked = lambda s: s["asked"].append(path)
    if "PALIMP_SERVICE" not in os.environ:  # a service without products
        return {"content": []}
    if path == "bulario":
        _state(asked)
        n = params["filter[numeroRegistro]"]
        return {"content": [{"idProduto": int(n), "numeroRegistro": n, "nomeProduto": f"P{n}", "data": "2024-03-01T01:00:00.000-0300"}] if n in ("100", "200", "300") else []}
    if path.startswith("bulario/"):
        state = _state(lambda s: (asked(s), s.update(generation=s["generation"] + 1)))
        token, product = state["generation"], path.split("/")[1]
        items = [{"idDocumento": d, "expediente": f"e{d}", "dataPublicacao": f"2024-0{d}-01T00:00:00.000-0300", "descSituacao": "ok", "idBulaPaciente": f"{token}-{product}-{d}-vp", "idBulaProfissional": f"{token}-{product}-{d}-vps" if d != 2 else None} for d in (1, 2, 3)]
        return {"historico": {"content": items, "totalElements": 3, "totalPages": 1}}
    if path.startswith("medicamento/produtos"):
        if path.endswith("/200"):
            raise HttpError(404)
        return {"principioAtivo": "x", "idBulaPaciente": "gone soon"}
    name = path.split("/")[-2]
    state = _state(asked)
    token, product, document, kind = name.split("-")
    if int(token) < state["generation"]:
        raise HttpError(403)
    if (product, document, kind) == ("200", "3", "vps"):
        raise HttpError(404)
    return b"odd" if product == "300" and document == "2" else name.split("-", 1)[1].encode()
