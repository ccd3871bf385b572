"""Files from an archive's web listing: retried requests, downloads that go on where they stopped, sizes checked, a manifest."""

from __future__ import annotations

import csv
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, fields

#: Answers that are worth another attempt, besides all from 500 on.
BUSY = (408, 429)


class Refused(PermissionError):
    """The archive wants other credentials; asking again is no use."""


def request(url: str, headers: dict[str, str] | None = None, attempts: int = 5, first_wait: float = 1.0, timeout: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """An open response. Network errors and busy answers are tried again, after what Retry-After says or a wait that doubles up to a minute."""
    for k in range(attempts):
        wait = min(60.0, first_wait * 2**k)
        try:
            return urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout)
        except urllib.error.HTTPError as e:
            if e.code in (401, 403):
                raise Refused(url) from e
            if e.code < 500 and e.code not in BUSY:
                raise
            said = e.headers.get("Retry-After", "")
            wait = min(60.0, float(said)) if said.isdigit() else wait
            error: Exception = e
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            error = e
        if k + 1 < attempts:
            sleep(wait)
    raise ConnectionError(f"{url}: no answer in {attempts} attempts") from error


@dataclass
class Entry:
    year: int
    name: str
    url: str
    size: int
    path: str
    status: str = "INCOMPLETE"
    have: int = 0


def listing(text: str, url: str) -> Iterable[tuple[str, int]]:
    """(address, bytes) of the files that a folder's page names: links below the folder itself, each followed by its size."""
    base = urllib.parse.urlparse(url)
    for href, rest in re.findall(r"<a\s[^>]*href=[\"']([^\"']+)[\"'][^>]*>.*?</a>([^<]*)", text, re.IGNORECASE | re.DOTALL):
        found = urllib.parse.urlparse(urllib.parse.urljoin(url, href))
        if (found.scheme, found.netloc) != (base.scheme, base.netloc) or not found.path.startswith(base.path) or found.path.endswith("/"):
            continue
        size = rest.split()[-1] if rest.split() else ""
        if not size.isdigit():
            raise ValueError(f"{found.path}: the listing gives no size in bytes")
        yield found._replace(path=urllib.parse.quote(found.path, safe="/%"), query="", fragment="").geturl(), int(size)


def enumerate_year(root: str, year: int, target: str, **options) -> list[Entry]:
    """The files of a year, by name, with what is here of each; a year without files is an error."""
    url = f"{root.rstrip('/')}/{year}/"
    with request(url, **options) as page:
        text = page.read().decode("utf-8", "replace")
    out = []
    for at, size in listing(text, url):
        name = urllib.parse.unquote(at.rsplit("/", 1)[-1])
        out.append(looked_at(Entry(year, name, at, size, os.path.join(target, str(year), name))))
    if not out:
        raise ValueError(f"{url}: no files")
    return sorted(out, key=lambda e: e.name)


def looked_at(entry: Entry) -> Entry:
    """The entry with the bytes that are here; complete where they are as many as the listing says."""
    whole, part = (os.path.getsize(p) if os.path.isfile(p) else 0 for p in (entry.path, f"{entry.path}.part"))
    entry.status, entry.have = ("COMPLETE", whole) if whole == entry.size else ("INCOMPLETE", max(whole, part))
    return entry


def download(entry: Entry, **options) -> Entry:
    """The file at its path, all of it or, as .part, what came: bytes that are here aren't asked for again where the server gives ranges. A complete file isn't touched."""
    if looked_at(entry).status == "COMPLETE":
        return entry
    part = f"{entry.path}.part"
    os.makedirs(os.path.dirname(entry.path), exist_ok=True)
    have = os.path.getsize(part) if os.path.isfile(part) else 0
    if have > entry.size:
        os.unlink(part)
        have = 0
    if have < entry.size or not entry.size:
        with request(entry.url, {"Range": f"bytes={have}-"} if have else {}, **options) as answer:
            goes_on = answer.status == 206 and answer.headers.get("Content-Range", "").startswith(f"bytes {have}-")
            with open(part, "ab" if goes_on else "wb") as out:
                while block := answer.read(1 << 20):
                    out.write(block)
    if (got := os.path.getsize(part)) != entry.size:
        raise ValueError(f"{entry.name}: {got} bytes, {entry.size} in the listing")
    os.replace(part, entry.path)
    return looked_at(entry)


def validate(entries: list[Entry]) -> list[str]:
    """What is wrong with what is here: files that are missing or of another size, and names that stand twice."""
    out = [f"{e.name}: {e.have} of {e.size} bytes" for e in map(looked_at, entries) if e.status != "COMPLETE"]
    names = [(e.year, e.name) for e in entries]
    return out + [f"{n}: listed more than once" for y, n in sorted({x for x in names if names.count(x) > 1})]


def write_manifest(entries: list[Entry], path: str) -> None:
    """One line a file, in place only when it is whole."""
    with open(f"{path}.tmp", "w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, [x.name for x in fields(Entry)])
        out.writeheader()
        out.writerows(map(asdict, entries))
    os.replace(f"{path}.tmp", path)
