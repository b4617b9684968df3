"""Licence scans by ordered signature rules (operator 4)."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metricloom.llm.support import LOWER, as_bytes

# A word byte is a lower-case letter, a digit or part of a character beyond ASCII.
NOT_WORD = np.ones(256, bool)
NOT_WORD[0x30:0x3A] = NOT_WORD[0x61:0x7B] = NOT_WORD[0x80:] = False
# Lower-cases A-Z and makes a space of all that is not in a word.
NORMAL = bytes(int(LOWER[b]) if not NOT_WORD[LOWER[b]] else 0x20 for b in range(256))

BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)


# The gate of each base phrase.
KEYWORDS = {"mit": "mit", "apache-2": "apache", "cc-by-nc": "cc"}


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched on words joined by single spaces; lower ``priority`` wins overlaps."""

    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


# (label, keyword, names as patterns). Written for words in lower case joined by single spaces.
FAMILIES = (
    ("mit", "mit", r"mit|mit x11|x11 mit"),
    ("apache-2", "apache", r"apache 2(?: 0)?|apache(?: software)? license(?: version)? 2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version)? 1 1|apache 1 1"),
    ("apache-1.0", "apache", r"apache(?: software)? license(?: version)? 1 0|apache 1 0"),
    ("gpl-3.0", "gpl", r"gpl ?v?3(?: 0)?(?: only)?|gplv3"),
    ("gpl-2.0", "gpl", r"gpl ?v?2(?: 0)?(?: only)?|gplv2"),
    ("gpl-1.0", "gpl", r"gpl ?v?1(?: 0)?(?: only)?"),
    ("gpl-3.0", "general public", r"gnu general public license(?: version)? v?3(?: 0)?"),
    ("gpl-2.0", "general public", r"gnu general public license(?: version)? v?2(?: 0)?"),
    ("gpl", "general public", r"gnu general public license"),
    ("lgpl-3.0", "lgpl", r"lgpl ?v?3(?: 0)?|lgplv3"),
    ("lgpl-2.1", "lgpl", r"lgpl ?v?2 1|lgplv2 1"),
    ("lgpl-2.0", "lgpl", r"lgpl ?v?2(?: 0)?"),
    ("lgpl-3.0", "lesser general", r"gnu lesser general public license(?: version)? v?3(?: 0)?"),
    ("lgpl-2.1", "lesser general", r"gnu lesser general public license(?: version)? v?2 1"),
    ("lgpl", "lesser general", r"gnu lesser general public license"),
    ("lgpl", "library general", r"gnu library general public license"),
    ("agpl-3.0", "agpl", r"agpl ?v?3(?: 0)?|agplv3"),
    ("agpl-3.0", "affero", r"gnu affero general public license(?: version)?(?: v?3(?: 0)?)?"),
    ("gfdl", "free documentation", r"gnu free documentation license(?: version)?(?: 1 [123])?"),
    ("bsd-3-clause", "bsd", r"bsd 3(?: clause)?|(?:3 clause|three clause|new|modified|revised) bsd"),
    ("bsd-2-clause", "bsd", r"bsd 2(?: clause)?|2 clause bsd|two clause bsd|simplified bsd"),
    ("bsd-2-clause", "freebsd", r"freebsd"),
    ("bsd-4-clause", "bsd", r"bsd 4(?: clause)?|4 clause bsd|original bsd|old bsd"),
    ("0bsd", "0bsd", r"0bsd"),
    ("0bsd", "zero clause", r"zero clause bsd"),
    ("mpl-2.0", "mpl", r"mpl ?v?2(?: 0)?"),
    ("mpl-1.1", "mpl", r"mpl ?v?1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version)? v?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version)? v?1 1"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version)? v?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version)? v?1(?: 0)?"),
    ("cddl-1.0", "cddl", r"cddl(?: 1 [01])?"),
    ("cddl-1.0", "common development", r"common development and distribution license"),
    ("cpl-1.0", "common public", r"common public license(?: version)?(?: 1 0)?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost-1.0", "boost", r"boost software license(?: version)?(?: 1 0)?"),
    ("artistic-2.0", "artistic", r"artistic license(?: version)? 2(?: 0)?"),
    ("artistic-1.0", "artistic", r"(?:perl )?artistic license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2.0", "python", r"python software foundation license(?: version)?(?: 2(?: 0)?)?"),
    ("python-2.0", "psf", r"psf license"),
    ("ruby", "ruby", r"ruby license"),
    ("php-3.01", "php", r"php license(?: version)?(?: 3 01| 3 0)?"),
    ("openssl", "openssl", r"openssl license"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?: version)?(?: 1 1)?"),
    ("eupl-1.2", "european union", r"european union public license(?: version)?(?: v?1 [012])?"),
    ("ms-pl", "microsoft public", r"microsoft public license"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license"),
    ("odbl-1.0", "open database", r"open database license(?: version)?(?: 1 0)?|odc open database license"),
    ("odc-by", "open data commons", r"open data commons attribution license"),
    ("pddl", "public domain", r"public domain dedication and license"),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("vim", "vim", r"vim license"),
    ("tex", "latex", r"latex project public license"),
    ("upl-1.0", "universal permissive", r"universal permissive license"),
    ("bsl-1.1", "business source", r"business source license(?: 1 1)?"),
    ("sspl-1.0", "server side", r"server side public license"),
    ("elastic-2.0", "elastic", r"elastic license(?: 2 0| v2)?"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?"),
    ("openrail", "open rail", r"(?:creativeml |bigscience )?open rail(?: m)?"),
    ("proprietary", "rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary"),
)

# The licences' own words, by which a text is known without its name.
SENTENCES = (
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-2-clause", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products"),
    ("apache-2", "apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3.0", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2.0", "redistribute", r"redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("boost-1.0", "machine executable", r"machine executable object code generated by a source language processor"),
)

# Grants that make a name a licence statement, and how sure each is.
GRANTS = (
    (r"(?:released|licensed|distributed|available|published|provided)(?: to you)? under(?: the)?(?: terms of)?(?: the)? (?:{name})(?: license| licence)?", 0.95),
    (r"under(?: the)? (?:{name}) (?:license|licence)", 0.9),
    (r"(?:spdx )?license identifier (?:{name})", 1.0),
    (r"(?:{name}) (?:license|licence)", 0.6),
)
# Names that say what they are without a grant.
NAMED = ("license", "licence", "cc0", "unlicense", "wtfpl", "in|into|to", "all rights", "proprietary", "openrail", "open rail", "gpl", "mpl ", "cddl")


def _creative_commons() -> Iterator[tuple[str, str, str]]:
    for parts in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"):
        label = f"cc-{parts.replace(' ', '-')}"
        yield label, "cc", rf"cc {parts}(?: [1234] [05])?(?: (?:international|unported))?"
    for parts, words in (
        ("by", "attribution"),
        ("by-sa", "attribution share ?alike"),
        ("by-nc", "attribution non ?commercial"),
        ("by-nd", "attribution no ?deriv(?:ative)?s?"),
        ("by-nc-sa", "attribution non ?commercial share ?alike"),
        ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
    ):
        yield f"cc-{parts}", "creative commons", rf"creative commons {words}(?: license)?(?: [1234] [05])?(?: (?:international|unported))?(?: license)?"


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: sentences, grants of names, then bare names."""
    found: list[Rule] = []

    def add(label: str, keyword: str, pattern: str, weight: float) -> None:
        found.append(Rule(label, keyword, pattern, len(found), weight))

    for label, keyword, pattern in SENTENCES:
        add(label, keyword, pattern, 1.0)
    names = (*FAMILIES, *_creative_commons())
    for grant, weight in GRANTS:
        for label, keyword, name in names:
            add(label, keyword, grant.format(name=name), weight)
    for label, keyword, name in names:
        if keyword in ("cc", "creative commons") or any(x in name for x in NAMED):
            add(label, keyword, name, 0.5)
    return tuple(found)


class LicenseScanner:
    """Keyword automaton and compiled rules; one for each worker process."""

    def __init__(self) -> None:
        self.gate = ahocorasick.Automaton()
        self.by_keyword: dict[str, list[tuple[Rule, re.Pattern[bytes]]]] = {}
        for rule in rules():
            compiled = re.compile(rb"(?<=\s)(?:" + rule.pattern.encode() + rb")(?=\s)")
            self.by_keyword.setdefault(rule.keyword, []).append((rule, compiled))
        self.base = [(label, KEYWORDS[label], re.compile(rf"(?<=\s){phrase}(?=\s)".encode())) for label, phrase in BASE_PHRASES]
        for keyword in {*self.by_keyword, *(last for _, last, _ in self.base)}:
            self.gate.add_word(f" {keyword}", keyword)
        self.gate.make_automaton()

    def keywords(self, words: bytes) -> set[str]:
        return {keyword for _, keyword in self.gate.iter(words.decode("latin-1"))}

    def detections(self, words: bytes, keywords: set[str]) -> list[tuple[int, int, Rule]]:
        """Accepted detections in a text of single-spaced words, as byte spans in order.

        A match inside another one's span is suppressed; of equal spans the earlier rule stays. Of
        matches that overlap in part, the one of the earlier rule stays. Matches inside one that does
        not stay are then treated likewise, where they do not touch what stays.
        """
        found = [(m.start(), m.end(), rule) for k in keywords for rule, p in self.by_keyword.get(k, ()) for m in p.finditer(words)]
        found.sort(key=lambda x: (x[0], -x[1], x[2].priority))
        kept: list[tuple[int, int, Rule]] = []

        def place(start: int, end: int) -> int | None:
            at = bisect.bisect_left(kept, start, key=lambda x: x[0])
            return at if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]) else None

        while found:
            outer, inner, reach = [], [], 0
            for match in found:
                (outer if match[1] > reach else inner).append(match)
                reach = max(reach, match[1])
            for match in sorted(outer, key=lambda x: (x[2].priority, x[0])):
                at = place(*match[:2])
                if at is not None:
                    kept.insert(at, match)
            found = [match for match in inner if place(*match[:2]) is not None]
        return kept

    def base_places(self, words: bytes, keywords: set[str]) -> list[tuple[int, str]]:
        return sorted((m.start(), label) for label, last, p in self.base if last in keywords for m in p.finditer(words))


@lru_cache(maxsize=1)
def _scanner() -> LicenseScanner:
    return LicenseScanner()


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = _scanner()
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for text in batch.column(1):
            words = b" ".join([b"", *(text.as_buffer().to_pybytes() if text.is_valid else b"").translate(NORMAL).split(), b""])
            keywords = scanner.keywords(words)
            base = scanner.base_places(words, keywords) if keywords else []
            found = scanner.detections(words, keywords) if keywords else []
            labels = {label for _, label in base}
            row = (
                max(0, words.count(b" ") - 1),
                len(base),
                words.count(b" ", 0, base[0][0]) - 1 if base else None,
                words.count(b" ", 0, base[-1][0]) - 1 if base else None,
                ",".join(sorted(labels)),
                ",".join(sorted(labels | {rule.label for _, _, rule in found})),
                max([0.9 if base else 0.0, *(rule.weight for _, _, rule in found)]),
                len(found),
            )
            for values, value in zip(out, row, strict=True):
                values.append(value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], _SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", "))


def license_scan(docs: DataFrame) -> DataFrame:
    """Licence labels of every document, from its whole text.

    Words are runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z. ``n_base``,
    ``first_word``, ``last_word`` and ``base_labels`` are of the fixed phrases; ``labels`` adds those
    of the rules; ``score`` is the surest accepted statement, 0 without one. A null or empty text has
    no words and no labels; repeated rows are scanned each; an empty table gives no rows. Only
    doc_id and text are read.
    """
    return docs.select("doc_id", as_bytes("text")).mapInArrow(_scan, _SCHEMA)
