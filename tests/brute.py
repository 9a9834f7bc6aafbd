"""Plain one-record-at-a-time versions of the operators, to test against."""

from __future__ import annotations

import json
from collections import defaultdict


def drift_types(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, list):
        return ("array", frozenset(t for t in map(drift_types, value) if t is not None))
    return {int: "integer", float: "decimal", str: "string", dict: "object"}[type(value)]


def drift_cases(lines, files):
    """lines: (file, text); files: (file, stream, seq) -> {(file, field, change)}"""
    schema = defaultdict(lambda: defaultdict(set))
    for file, text in lines:
        for key, value in json.loads(text).items():
            found = schema[file][key]
            if (t := drift_types(value)) is not None:
                found.add(t)
    streams = defaultdict(list)
    for file, stream, seq in files:
        streams[stream].append((seq, file))
    out = set()
    for order in streams.values():
        order.sort()
        for (_, before), (_, file) in zip(order, order[1:]):
            a = {k: frozenset(v) for k, v in schema[before].items()}
            b = {k: frozenset(v) for k, v in schema[file].items()}
            out |= {(file, k, "retyped") for k in a.keys() & b.keys() if a[k] != b[k]}
            gone, new = a.keys() - b.keys(), b.keys() - a.keys()
            used = set()
            for k in gone:
                twins, partners = [g for g in gone if a[g] == a[k]], [n for n in new if b[n] == a[k]]
                if len(twins) == len(partners) == 1:
                    out.add((file, k, "renamed"))
                    used |= set(partners)
                else:
                    out.add((file, k, "removed"))
            out |= {(file, k, "added") for k in new - used}
    return out


def _open(value):
    while isinstance(value, str):
        try:
            inner = json.loads(value)
        except ValueError:
            return value
        if not isinstance(inner, (dict, list, str)):
            return value
        value = inner
    return value


def _feature(value):
    if isinstance(value, dict):
        value = value.get("input")
    text = str(value).strip().lower().removeprefix("x")
    return int(text) if text.isdigit() else None


def learning_cases(results):
    """results: (result_id, nout, target_order, extra) -> {(result, stage, target, feature)}"""
    out = set()
    for result, nout, order_text, extra_text in results:
        extra = _open(extra_text)
        while isinstance(extra, dict) and "extra" in extra:
            extra = _open(extra["extra"])
        if not isinstance(extra, dict):
            continue
        order = _open(order_text)
        if order in ("lsb", "msb"):
            places = dict(enumerate(range(nout) if order == "lsb" else range(nout)[::-1]))
        elif isinstance(order, list):
            places = {}
            for i, entry in enumerate(order):
                if isinstance(entry, dict):
                    places[int(entry.get("rank", i))] = int(entry["target"])
                else:
                    places[i] = int(entry)
        else:
            places = {}
        sets = [(i, None, fs) for i, fs in enumerate(extra.get("feature_sets") or [])]
        for i, stratum in enumerate(extra.get("strata") or []):
            targets = stratum.get("targets") or []
            sets += [(stratum.get("stage", i), t.get("target"), t.get("fs")) for t in ([targets] if isinstance(targets, dict) else targets)]
        sets += [(s.get("stage", i), s.get("target"), (s.get("feature_set") or {}).get("features")) for i, s in enumerate(extra.get("stages") or [])]
        for stage, target, fs in sets:
            target = places.get(stage) if target is None else target
            if target is not None:
                out |= {(result, stage, target, f) for f in map(_feature, fs or []) if f is not None}
    return out
