"""The scalar functions once more as DuckDB SQL, for checking the Spark ones."""

from __future__ import annotations

from collections.abc import Sequence

from feedloom.functions import rules
from feedloom.functions.text import WS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(u: str) -> str:
    return rf"regexp_replace(regexp_replace({u}, '[\t\r\n]', '', 'g'), '^[\x00-\x20]+', '')"


def canon(u: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(regexp_extract({clean(u)}, '^([A-Za-z][^:/?#]*://[^/?#]*[^?#]*)', 1), '(://.*/[^/;]*);[^/]*$', '\1'), '/+$', ''))"


def netloc(u: str) -> str:
    return rf"regexp_extract({clean(u)}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"


def path(u: str) -> str:
    return rf"regexp_replace(regexp_extract({clean(u)}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '(/[^/;]*);[^/]*$', '\1')"


def host(u: str) -> str:
    return rf"regexp_replace(lower({netloc(u)}), '^www\.', '')"


def schemed(u: str) -> str:
    return f"(case when regexp_matches({u}, '^https?://') then {u} else 'https://' || {u} end)"


def domain(u: str) -> str:
    return f"(case when coalesce({u}, '') = '' then '' else {host(schemed(u))} end)"


def root(u: str) -> str:
    full = schemed(u)
    return rf"(case when coalesce({u}, '') != '' and {netloc(full)} != '' then lower(regexp_extract({clean(full)}, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) || '://' || {netloc(full)} end)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def name(x: str) -> str:
    words = "lower(" + collapse(rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s\p{{Z}}]', ' ', 'g')") + ")"
    return strip(rf"regexp_replace(replace({words}, 'ß', 'ss'), '(\s+({'|'.join(rules.LEGAL_SUFFIXES)}))+$', '')")


def slug(x: str, n: int = 60) -> str:
    return f"coalesce(nullif(left(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), {n}), ''), 'role')"


def any_of(x: str, words: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains(lower({x}), {quoted(w)})" for w in words) + ")"


def label(x: str, pairs: Sequence[tuple[str, str]], default: str | None = None) -> str:
    whens = " ".join(f"when contains(lower({x}), {quoted(a)}) then {quoted(b)}" for a, b in pairs)
    return f"(case {whens} {'else ' + quoted(default) if default is not None else ''} end)"


def job_post(u: str) -> str:
    return f"regexp_matches(lower({u}), {quoted('|'.join(f'(?:{p})' for p in rules.JOB_POST_PATTERNS))})"


def feed_key(on_page: str, company: str, title: str, url: str) -> str:
    title_ = collapse(f"coalesce({title}, '')")
    return f"(case when coalesce({on_page}, false) then 'onpage::' || lower(coalesce({company}, '')) || '::' || lower({title_}) else {canon(url)} end)"


def slug_title(u: str) -> str:
    segment = rf"regexp_replace(regexp_extract(regexp_replace({path(u)}, '/+$', ''), '([^/]*)$', 1), '-\d+$', '')"
    words = f"string_split(trim(regexp_replace({segment}, '-+', ' ', 'g')), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"


def count_words(x: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"(length(lower({x})) - length(replace(lower({x}), {quoted(w)}, ''))) // {len(w)}" for w in words) + ")"


def score(u: str, x: str) -> str:
    return (
        f"(case when {any_of(x, rules.MAPPER_HOSTS)} then 5 else 0 end + least({count_words(x, rules.CAREERS_WORDS)}, 6)"
        f" + case when regexp_matches(lower({path(u)}), {quoted(rules.CAREERS_PATH)}) then 3 else 0 end"
        f" + least(len(regexp_extract_all(lower({x}), {quoted(rules.APPLY_LINKS)})) // 3, 3))"
    )


def isin(x: str, values: Sequence[str]) -> str:
    return f"{x} in ({', '.join(map(quoted, values))})"


def best_title(anchor: str, page_title: str) -> str:
    a, p = strip(f"coalesce({anchor}, '')"), strip(f"coalesce({page_title}, '')")
    part = strip(f"string_split_regex({p}, '{WS}[|\\-–—]{WS}')[1]")
    return f"(case when ({isin(f'lower({a})', rules.GENERIC_TITLES)} or length({a}) < 4 or not regexp_matches({a}, '[A-Za-z]{{3,}}')) and {part} != '' then {part} else {a} end)"


def pick_title(anchor: str, h1: str, page_title: str, structured: str, url: str) -> str:
    s, h, u = collapse(f"coalesce({structured}, '')"), collapse(f"coalesce({h1}, '')"), slug_title(f"coalesce({url}, '')")
    ok = lambda t, low, high: f"length({t}) between {low} and {high} and not {isin(f'lower({t})', rules.JUNK_TITLES)}"
    return f"(case when {ok(s, 3, 120)} then {s} when {ok(h, 3, 100)} then {h} when {ok(u, 3, 100)} and regexp_matches({u}, '[A-Za-z]{{3,}}') then {u} else {best_title(anchor, page_title)} end)"
