"""URL resolution as browsers do it, vectorised over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from domweave.sources.pages import PART_NODES, parts

_PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}
_SCHEME = re.compile(r"([a-zA-Z][a-zA-Z0-9+.\-]*):(.*)", re.S)
_PATH_KEEP = "/:@!$&'()*+,;=%~[]|^\\"
_QUERY_KEEP = "/:@!$&()*+,;=%~?[]|^`{}\\"
_FRAGMENT_KEEP = "/:@!$&'()*+,;=%~?#[]|^{}\\"


def _segments(path: str) -> str:
    """The path without dot segments."""
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        low, final = part.lower().replace("%2e", "."), k == len(parts) - 1
        if low == "..":
            del out[-1:]
            if final:
                out.append("")
        elif low == ".":
            if final:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def _host(text: str) -> str | None:
    text = text.lower()
    if not text or re.search(r"[\x00-\x20#/<>?@\\^|%]", text):
        return None
    if text.isascii():
        return text
    try:
        return text.encode("idna").decode("ascii")
    except UnicodeError:
        return None


def _authority(scheme: str, text: str) -> str | None:
    user, _, rest = text.rpartition("@")
    m = re.fullmatch(r"(\[[0-9a-fA-F:.]+\]|[^:]*)(?::(\d*))?", rest)
    if m is None or (host := m[1].lower() if m[1].startswith("[") else _host(m[1])) is None:
        return None
    port = m[2] or ""
    if port and int(port) > 65535:
        return None
    port = str(int(port)) if port else ""
    return (f"{user}@" if user else "") + host + (f":{port}" if port and port != _PORTS[scheme] else "")


def _split(rest: str) -> tuple[str, str | None, str | None]:
    rest, mark, fragment = rest.partition("#")
    path, question, query = rest.partition("?")
    return path, query if question else None, fragment if mark else None


def _join(scheme: str, authority: str, path: str, query: str | None, fragment: str | None) -> str:
    out = f"{scheme}://{authority}{quote(_segments(path or '/'), safe=_PATH_KEEP)}"
    if query is not None:
        out += "?" + quote(query, safe=_QUERY_KEEP)
    if fragment is not None:
        out += "#" + quote(fragment, safe=_FRAGMENT_KEEP)
    return out


@lru_cache(maxsize=65536)
def parse_url(url: str) -> tuple[str, str, str, str | None, str | None] | None:
    """(scheme, authority, path, query, fragment) of an absolute URL; None if it isn't one. Other schemes have all in path."""
    url = re.sub("[\t\n\r]", "", url.strip("".join(map(chr, range(33)))))
    m = _SCHEME.fullmatch(url)
    if m is None:
        return None
    scheme = m[1].lower()
    if scheme not in _PORTS:
        return scheme, "", m[2], None, None
    path, query, fragment = _split(m[2])
    path = path.replace("\\", "/").lstrip("/")
    text, _, rest = path.partition("/")
    authority = _authority(scheme, text)
    return None if authority is None else (scheme, authority, "/" + rest, query, fragment)


def resolve(base: str | None, reference: str | None) -> str | None:
    """The reference resolved against the base; None where either is null or can't be parsed."""
    if base is None or reference is None or (b := parse_url(base)) is None:
        return None
    scheme, authority, path, query, _ = b
    reference = re.sub("[\t\n\r]", "", reference.strip("".join(map(chr, range(33)))))
    m = _SCHEME.fullmatch(reference)
    if m is not None and not (m[1].lower() == scheme and scheme in _PORTS and m[2][:1] not in "/\\"):
        p = parse_url(reference)
        if p is None:
            return None
        return _join(*p) if p[0] in _PORTS else f"{p[0]}:{p[2]}"
    if m is not None:
        reference = m[2]
    if scheme not in _PORTS:
        return None
    r_path, r_query, r_fragment = _split(reference)
    r_path = r_path.replace("\\", "/")
    if r_path.startswith("//"):
        text, _, rest = r_path.lstrip("/").partition("/")
        other = _authority(scheme, text)
        return None if other is None else _join(scheme, other, "/" + rest, r_query, r_fragment)
    if r_path.startswith("/"):
        path = r_path
    elif r_path:
        path = path.rpartition("/")[0] + "/" + r_path
    if r_path or r_query is not None:
        query = r_query
    return _join(scheme, authority, path, query, r_fragment)


def url_join(base: Column, reference: Column) -> Column:
    """One reference for each row; null where it can't be resolved."""

    def one(bases: pa.Array, references: pa.Array) -> pa.Array:
        return pa.array([resolve(b, r) for b, r in zip(bases.to_pylist(), references.to_pylist())], pa.string())

    return F.arrow_udf(one, "string")(base, reference)


def resolve_lists(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Lists of references resolved against their bases, some rows at a time; what can't be resolved stays as it is."""
    for bases, lists in batches:
        for part in parts(pc.list_value_length(lists), PART_NODES):
            rows = zip(bases[part].to_pylist(), lists[part].to_pylist())
            yield pa.array([None if xs is None else [x if (y := resolve(b, x)) is None else y for x in xs] for b, xs in rows], pa.list_(pa.string()))


def url_join_all(base: Column, references: Column) -> Column:
    """An array of references for each row; those that can't be resolved stay as they are."""
    # not deterministic, or the filter that an explode implies would be pushed below it with a copy of it
    return F.arrow_udf(resolve_lists, "array<string>").asNondeterministic()(base, references)
