"""The parameters of an audit and their validation."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import partial

# Bounds of the integer parameters.
INTEGER_BOUNDS = {"max_pages": (1, 1000), "max_depth": (0, 10), "max_concurrency": (1, 8), "request_timeout_secs": (5, 60)}
FLAGS = ("respect_robots_txt", "detect_duplicates", "check_ai_metadata")
PATTERN_LISTS = ("include_patterns", "exclude_patterns")
MAX_PATTERNS, MAX_PATTERN_CHARS = 20, 200
# What a dataset is named, and the messages of the public contract.
DATASET_ID = re.compile(r"[A-Za-z0-9_-]{1,100}(?:~[A-Za-z0-9_-]{1,100})?")
NOT_AN_OBJECT = "Input must be a JSON object."
UNKNOWN_FIELDS = "Unknown input fields: {}"
NOT_AN_INTEGER = "{} must be an integer between {} and {}."
NOT_A_BOOLEAN = "{} must be a boolean."
NOT_A_LIST = f"{{}} must be a list of at most {MAX_PATTERNS} URL globs."
NOT_PATTERNS = f"{{}} must contain nonempty glob strings up to {MAX_PATTERN_CHARS} characters."
NOT_A_STRING = "{} must be a string."
WRONG_MODE, NO_WEBSITE, NO_DATASET = "mode must be website or dataset.", "Provide a website URL.", "Provide a dataset ID or owner~dataset name, not a URL."


@dataclass(frozen=True)
class AuditConfig:
    """Parameters of one audit. ``max_pages`` None means all rows; strict inputs have 1 to 1000."""

    mode: str = "dataset"
    start_url: str = ""
    dataset_id: str = ""
    max_pages: int | None = 50
    max_depth: int = 3
    include_patterns: tuple[str, ...] = ()
    exclude_patterns: tuple[str, ...] = ()
    respect_robots_txt: bool = True
    detect_duplicates: bool = True
    check_ai_metadata: bool = True
    max_concurrency: int = 4
    request_timeout_secs: int = 25


def _whole(value: object, low: int, high: int) -> bool:
    return type(value) is int and low <= value <= high


#: Rules in the order they are told: names of fields, the test that a value passes, the message if it fails.
_RULES: list[tuple[tuple[str, ...], Callable[[object], bool], str]] = [
    *(((n,), partial(_whole, low=low, high=high), NOT_AN_INTEGER.format("{}", low, high)) for n, (low, high) in INTEGER_BOUNDS.items()),
    (FLAGS, lambda v: isinstance(v, bool), NOT_A_BOOLEAN),
    (PATTERN_LISTS, lambda v: isinstance(v, list) and len(v) <= MAX_PATTERNS, NOT_A_LIST),
    (PATTERN_LISTS, lambda v: not isinstance(v, list) or len(v) > MAX_PATTERNS or all(isinstance(p, str) and 0 < len(p) <= MAX_PATTERN_CHARS for p in v), NOT_PATTERNS),
    (("mode", "start_url", "dataset_id"), lambda v: isinstance(v, str), NOT_A_STRING),
]


def problems(data: object) -> list[str]:
    """What is wrong with an input, in words; an empty list if nothing is."""
    if not isinstance(data, dict | None):
        return [NOT_AN_OBJECT]
    given = data or {}
    strange = sorted(str(k) for k in given if k not in {f.name for f in fields(AuditConfig)})
    found = [UNKNOWN_FIELDS.format(", ".join(strange))] if strange else []
    found += [message.format(name) for names, passes, message in _RULES for name in names if name in given and not passes(given[name])]
    mode, start, dataset = given.get("mode", "website"), given.get("start_url", ""), given.get("dataset_id", "")
    if all(isinstance(x, str) for x in (mode, start, dataset)):
        asked = {"website": (start.strip(), NO_WEBSITE), "dataset": (DATASET_ID.fullmatch(dataset), NO_DATASET)}
        fine, message = asked.get(mode, (None, WRONG_MODE))
        found += [] if fine else [message]
    return found


def validate(data: object) -> AuditConfig:
    """The configuration that ``data`` gives; raises ``ValueError`` with the first problem."""
    wrong = problems(data)
    if wrong:
        raise ValueError(wrong[0])
    values = {"mode": "website"} | dict(data or {})
    return AuditConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
