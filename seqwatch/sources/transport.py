"""How requests are answered: over the network, or from replies that have landed in a folder. And how often one is tried.

A transport is made in the task that uses it, from options that are plain text.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections import OrderedDict
from collections.abc import Callable, Mapping
from typing import NamedTuple, Protocol

from pyarrow import fs
from pyspark.sql import Column, functions as F

from seqwatch.operators.fetches import MAX_ATTEMPTS, STATUS_OK

# Fixed value: seconds to wait after the first failed try; after the second twice as long, and so on.
PAUSE = 3.0
#: Seconds until a request is given up.
TIMEOUT = 60.0
SEARCH, FETCH = "search", "fetch"


class Reply(NamedTuple):
    """Status and text of an answer, or neither, and what went wrong."""

    status: int | None
    body: str | None
    error: str | None = None


class Answer(NamedTuple):
    """How a request ended: the number of its last try and that try's reply, without a body unless it succeeded."""

    attempt: int
    status: int | None
    body: str | None
    error: str | None


class Transport(Protocol):
    def get(self, kind: str, key: str, attempt: int) -> Reply:
        """The reply to one try of a request: of kind "search" for an offset, or "fetch" for an id."""


def request(
    transport: Transport, kind: str, key: str, max_attempts: int = MAX_ATTEMPTS, pause: float = PAUSE, wait: Callable[[float], None] = time.sleep
) -> Answer:
    """Try until one succeeds, with pauses that grow; a transport that raises has failed that try."""
    reply, attempt = Reply(None, None), 0
    for attempt in range(1, max_attempts + 1):
        try:
            reply = transport.get(kind, key, attempt)
        except Exception as error:  # whatever a network does is a failed try
            reply = Reply(None, None, type(error).__name__)
        if reply.status == STATUS_OK:
            return Answer(attempt, reply.status, reply.body, None)
        if attempt < max_attempts:
            wait(pause * attempt)
    return Answer(attempt, reply.status, None, reply.error or "no success")


class HttpTransport:
    """Requests over the network. The addresses are templates with {key} in the place of the offset or the id.

    Errors name their kind only: an address may hold a key that is nobody else's business.
    """

    def __init__(self, options: Mapping[str, str]):
        self.addresses = {SEARCH: options.get("search_url"), FETCH: options.get("fetch_url")}
        self.timeout = float(options.get("timeout", TIMEOUT))

    def get(self, kind: str, key: str, attempt: int) -> Reply:
        address = self.addresses[kind]
        if not address:
            raise ValueError(f"no {kind}_url")
        try:
            with urllib.request.urlopen(address.replace("{key}", urllib.parse.quote(key, safe="")), timeout=self.timeout) as answer:
                return Reply(answer.status, answer.read().decode("utf-8", "replace"))
        except urllib.error.HTTPError as error:
            return Reply(error.code, None, "HTTPError")


class FolderTransport:
    """Replies in the folder ``replies``, as ``land_replies`` writes them in ``buckets``. A try of which none has landed has failed.

    A request's replies are in one of many files; the last few that were read are kept.
    """

    KEPT = 8

    def __init__(self, options: Mapping[str, str]):
        from seqwatch.sinks.line_files import located

        self.system, self.folder = located(options["replies"])
        self.buckets = int(options["buckets"])
        self.read: OrderedDict[int, dict[tuple[str, str, int], Reply]] = OrderedDict()

    def get(self, kind: str, key: str, attempt: int) -> Reply:
        return self._bucket(bucket_of(kind, key, self.buckets)).get((kind, key, attempt), Reply(None, None, "no reply"))

    def _bucket(self, number: int) -> dict[tuple[str, str, int], Reply]:
        if number not in self.read:
            found: dict[tuple[str, str, int], Reply] = {}
            place = fs.FileSelector(f"{self.folder}/bucket={number}", allow_not_found=True)
            for file in self.system.get_file_info(place):
                if file.base_name.startswith((".", "_")):
                    continue
                with self.system.open_input_stream(file.path) as text:
                    for line in text.read().decode("utf-8").splitlines():
                        row = json.loads(line)
                        found[row["kind"], row["key"], row["attempt"]] = Reply(row.get("status"), row.get("body"))
            self.read[number] = found
            while len(self.read) > self.KEPT:
                self.read.popitem(last=False)
        self.read.move_to_end(number)
        return self.read[number]


def bucket_of(kind: str, key: str, buckets: int) -> int:
    return zlib.crc32(f"{kind} {key}".encode()) % buckets


def bucket_column(kind: Column, key: Column, buckets: int) -> Column:
    """``bucket_of`` for columns."""
    return F.pmod(F.crc32(F.concat_ws(" ", kind, key).cast("binary")), F.lit(buckets)).cast("int")


def place_of(kind: str, key: Column, options: Mapping[str, str]) -> Column | None:
    """Where requests are answered from, for transports that answer many from one place."""
    return bucket_column(F.lit(kind), key, int(options["buckets"])) if options.get("transport") == "folder" else None


TRANSPORTS: dict[str, Callable[[Mapping[str, str]], Transport]] = {"http": HttpTransport, "folder": FolderTransport}


def transport_of(options: Mapping[str, str]) -> Transport:
    """The transport that the option ``transport`` names: "http", "folder", or "module:Class" for one's own."""
    name = options["transport"]
    if name in TRANSPORTS:
        return TRANSPORTS[name](options)
    module, _, member = name.partition(":")
    if not member:
        raise ValueError(f"no transport {name}")
    return getattr(importlib.import_module(module), member)(options)
