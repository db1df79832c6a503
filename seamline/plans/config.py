"""Settings of captures and merges, from dictionaries, JSON or YAML files."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from importlib.resources import files
from pathlib import Path
from typing import Any, get_type_hints

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.codec import bytes_to_long, int_at, long_at
from ..streaming.dedup import DedupProcessor


@dataclass(frozen=True)
class Spool:
    """``durable``: a log in which each payload is on disk before the next is received; else files,
    rolled every ``roll_ms``, until which payloads are in memory only."""

    path: str
    roll_ms: int = 1000
    durable: bool = False


@dataclass(frozen=True)
class KafkaTarget:
    producer: dict[str, str]
    topic: str
    partition: int


@dataclass(frozen=True)
class UdpSettings:
    iface: str
    group: str
    port: int
    mtu: int = 1500


@dataclass(frozen=True)
class WebsocketSettings:
    url: str
    charset: str = "UTF-8"


@dataclass(frozen=True)
class BusSettings:
    directory: str
    channel: str
    stream_id: int
    fragment_limit: int = 128


@dataclass(frozen=True)
class UdpCapture:
    receiver: UdpSettings
    spool: Spool
    kafka: KafkaTarget


@dataclass(frozen=True)
class WebsocketCapture:
    receiver: WebsocketSettings
    spool: Spool
    kafka: KafkaTarget


@dataclass(frozen=True)
class BusCapture:
    receiver: BusSettings
    spool: Spool
    kafka: KafkaTarget


@dataclass(frozen=True)
class StrategySettings:
    """A strategy's name in :data:`STRATEGIES`, and its properties."""

    impl: str
    props: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class DedupSettings:
    """``ordered`` holds for the captures and the strategy alike. ``commit_ms``: the trigger
    interval, 0 for as fast as possible."""

    group_prefix: str
    consumer: dict[str, str]
    producer: dict[str, str]
    inbound_topics: list[str]
    outbound_topic: str
    strategy: StrategySettings
    ordered: bool = False
    commit_ms: int = 0

    def __post_init__(self) -> None:
        if not self.inbound_topics:
            raise ValueError("inbound_topics is empty")


@dataclass(frozen=True)
class Strategy:
    """Where a record's sequence and producer are, how long a gap may last, and what decides."""

    sequence: Column
    producer_key: Column | None = None
    num_sequences: Column | None = None
    timeout_ms: int | None = 10_000
    expire_ms: int | None = None
    header_prefix: str = ""
    processor: type[DedupProcessor] = DedupProcessor


def _timeout(props: dict) -> int | None:
    """Milliseconds to wait for a missing sequence; null waits for ever."""
    given = props.get("gap_timeout_ms", 10_000)
    return None if given is None else int(given)


def _binary(column: str) -> Callable[[dict], Strategy]:
    def make(props: dict) -> Strategy:
        order = {"LITTLE_ENDIAN": "little", "BIG_ENDIAN": "big"}[props["byte_order"]]
        return Strategy(long_at(column, int(props["offset"]), order), timeout_ms=_timeout(props), header_prefix=props.get("header_prefix", ""))

    return make


def _long_key(props: dict) -> Strategy:
    return Strategy(bytes_to_long("key"), timeout_ms=_timeout(props), header_prefix=props.get("header_prefix", ""))


def _session(props: dict) -> Strategy:
    """The producer is the session number in the frame header that is the key."""
    session = int_at("key", int(props.get("session_offset", 12))).cast("string")
    expire = props.get("expire_seconds")
    return Strategy(
        long_at("value", int(props.get("offset", 0)), {"LITTLE_ENDIAN": "little", "BIG_ENDIAN": "big"}[props.get("byte_order", "LITTLE_ENDIAN")]), producer_key=session,
        timeout_ms=_timeout(props), expire_ms=None if expire is None else 1000 * int(expire),
    )


#: Strategies by name; a user may add more.
STRATEGIES: dict[str, Callable[[dict], Strategy]] = {"binary_key": _binary("key"), "binary_value": _binary("value"), "long_key": _long_key, "session": _session}


def strategy(settings: StrategySettings) -> Strategy:
    if settings.impl not in STRATEGIES:
        raise ValueError(f"no strategy {settings.impl!r}; there are {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[settings.impl](settings.props)


def from_dict(kind: type, given: dict[str, Any]) -> Any:
    """A settings object from nested dictionaries; unknown and missing keys raise."""
    hints, known = get_type_hints(kind), {f.name: f for f in fields(kind)}
    if unknown := set(given) - set(known):
        raise ValueError(f"{kind.__name__} has no {', '.join(sorted(unknown))}")
    if missing := [k for k, f in known.items() if k not in given and f.default is MISSING and f.default_factory is MISSING]:
        raise ValueError(f"{kind.__name__} needs {', '.join(missing)}")
    return kind(**{k: from_dict(hints[k], v) if is_dataclass(hints[k]) else v for k, v in given.items()})


def load(kind: type, name: str, package: str | None = None) -> Any:
    """Settings from a resource of a package, if it has one of that name, else from a file."""
    text = None
    if package is not None and (found := files(package) / name).is_file():
        text = found.read_text()
    text = Path(name).read_text() if text is None else text
    if name.endswith(".json"):
        return from_dict(kind, json.loads(text))
    import yaml

    return from_dict(kind, yaml.safe_load(text))
