"""Plays fetched over HTTP into a folder, where it can be reached."""

from __future__ import annotations

import gzip
import json
import os
from collections.abc import Callable, Iterator
from urllib.parse import quote
from urllib.request import urlopen

#: How a file packed by gzip begins.
PACKED = bytes([31, 139])


def _get(url: str) -> bytes:
    with urlopen(url, timeout=60) as r:  # noqa: S310
        return r.read()


def download(service: str, corpus: str, folder: str, fetch: Callable[[str], bytes] = _get) -> Iterator[str]:
    """Names of the plays of a corpus as they are written to folder as NAME.xml.

    service/corpora/CORPUS lists them, service/corpora/CORPUS/plays/NAME/tei gives one, perhaps packed by gzip. Those that are there already are not fetched again; a file
    gets its name when it is whole.
    """
    os.makedirs(folder, exist_ok=True)
    root = f"{service.rstrip('/')}/corpora/{quote(corpus)}"
    for play in json.loads(fetch(root))["plays"]:
        path = os.path.join(folder, f"{play['name']}.xml")
        if os.path.exists(path):
            continue
        data = fetch(f"{root}/plays/{quote(play['name'])}/tei")
        with open(f"{path}.tmp", "wb") as out:
            out.write(gzip.decompress(data) if data.startswith(PACKED) else data)
        os.replace(f"{path}.tmp", path)
        yield play["name"]
