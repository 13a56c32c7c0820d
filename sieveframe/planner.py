"""From a question to a query tree: the prompt, the reply's parser, and hints for another try."""

from __future__ import annotations

import json
from datetime import datetime

from .failures import ModelOutput, Unsupported
from .plans.ast import OPERATORS, VERSION, MalformedTree, Query, all_of, ago, query_from, where
from .plans.validate import ValidationFailed
from .sources.config import Config


def system_prompt(config: Config, now: datetime) -> str:
    """What a model may use: visible fields only, by their logical names, never their physical places."""
    lines = [
        f"Translate the user's question about {config.entity} into one JSON object and nothing else.",
        f"Now is {now.isoformat(timespec='seconds')}Z.",
        "Fields:",
    ]
    for f in sorted(config.fields, key=lambda f: -f.priority):
        if f.may_query:
            more = [f"values: {', '.join(f.values)}"] if f.values else []
            more += [f"also called: {', '.join(f.synonyms)}"] if f.synonyms else []
            more += [f"operators: {', '.join(f.allowed)}"] if f.may_filter else ["not for filters"]
            more += [] if f.may_sort else ["not for sorting"]
            more += [] if f.may_return else ["never selected"]
            kind = f"array of {f.item}" if f.type == "array" else f.type
            lines.append(f"- {f.name} ({kind}; {'; '.join(more)})")
    first = next((f for f in config.fields if f.may_query and f.may_filter), None)
    listed = next((f for f in config.fields if f.may_query and f.may_filter and "in" in f.allowed), first)
    dated = next((f for f in config.fields if f.may_query and f.may_filter and f.type == "date"), None)
    examples = []
    if listed:
        values = list(listed.values[:2]) or ([1, 2] if listed.item == "number" else ["a", "b"])
        examples.append(where(listed.name, "in" if "in" in listed.allowed else "equals", values))
    if dated:
        examples.append(where(dated.name, "after", ago(-30, "day")))
    if examples:
        tree = Query(config.entity, filter=examples[0] if len(examples) == 1 else all_of(*examples), limit=10)
        lines += ["The form of an answer, with a list and a relative date:", json.dumps(tree.to_json())]
    lines += [
        f"Operators: {', '.join(OPERATORS)}. Connectives: AND, OR, NOT (one child).",
        'A date is {"kind":"date","v":"2024-01-31"} or {"kind":"relative_date","unit":"day","amount":-7}.',
        "between takes an array of two values. isNull and isNotNull take no value.",
        'If these fields cannot answer the question, reply {"unsupported": "the reason"}.',
    ]
    return "\n".join(lines)


def repair_hint(error: Exception) -> str:
    if isinstance(error, ValidationFailed):
        told = [f"- {p.path}: {p.message}" + (f" (perhaps {', '.join(p.suggestions)})" if p.suggestions else "") for p in error.problems]
        return "Your last answer was not valid:\n" + "\n".join(told) + "\nAnswer with a corrected JSON object only."
    return "Your last answer was no JSON object of the asked form. Answer with the JSON object only."


def first_object(text: str) -> str | None:
    """The first balanced {...} outside of strings."""
    start, depth, quoted, i = -1, 0, False, 0
    while i < len(text):
        ch = text[i]
        if quoted:
            if ch == "\\":
                i += 1
            elif ch == '"':
                quoted = False
        elif ch == '"' and depth:
            quoted = True
        elif ch == "{":
            start, depth = (i if not depth else start), depth + 1
        elif ch == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
        i += 1
    return None


def parse_reply(text: str, config: Config) -> Query:
    found = first_object(text)
    if found is None:
        raise ModelOutput("the reply holds no JSON object")
    try:
        raw = json.loads(found)
        refusal = raw.get("unsupported")
        if isinstance(refusal, str) and refusal.strip():
            raise Unsupported(refusal.strip()[:500])
        q = query_from(raw)
    except (RecursionError, MalformedTree, json.JSONDecodeError) as e:
        raise ModelOutput("the reply is no query tree") from e
    if not any((q.select, q.filter, q.sort, q.limit, q.offset)) and not (q.entity or q.version):
        raise ModelOutput("the reply is empty")
    return Query(q.entity or config.entity, q.version or VERSION, q.select, q.filter, q.sort, q.limit, q.offset)
