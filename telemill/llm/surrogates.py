"""Replacement of personal data by keyed, type-consistent surrogates (operator 4).

A surrogate is derived from an HMAC of the entity's kind and normal form, so
every mention of an entity gets the same surrogate in every text without shared
state. It keeps what its kind promises: separators and length, letter case and
script, card issuer and check digit, public or private address range, top-level
domain, and for names the gender that the title tells. A whole and a partial
mention of a person agree, because given and family names are entities of
their own.

Two entities could still draw the same surrogate, or one that is a real entity
of the corpus. All distinct entities are therefore checked against each other;
of those that collide all but one draw again until none collide. These second
draws are the only ones that must be looked up.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm import text as T
from telemill.session import cut

MALE = "Mr Herr Señor Sr Monsieur Signor Mister г-н".split()
FEMALE = "Mrs Ms Miss Frau Señora Sra Madame Mme Signora г-жа".split()
# syllables that names are built from, by script; the last ones carry the gender
_NAME_PARTS = {
    "latin": ("ba da fe ga he jo ka la mi no pa ro sa te vi zo ber dan len mar".split(), "ro nd rt s l".split(), "ra na la tte lia".split()),
    "cyrillic": ("ба ва га да же зо ка ла ми но па ро са те фи ли бор дан лен мар".split(), "ор ан слав ил ег".split(), "ра на ла ия ина".split()),
    "greek": ("βα γα δε ζω θα κα λα μι νο πα ρο σα τε φι λι βορ δαν λεν μαρ".split(), "ος ης ων ας ιος".split(), "ρα να λα ία ίνα".split()),
}
_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_PLAIN = {c: s for s in _SETS for c in s}

_NAME = r"[^\W\d_a-z](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_PATTERNS = (  # kind, a string or pattern without which the search is spared, pattern; group 1, if any, is the entity
    ("email", "@", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@(?:[\w-]{1,63}\.)+[^\W\d_]{2,24}(?![\w-])")),
    ("secret", re.compile("[=:]"), re.compile(r"(?i:(?<!\w)(?:password|passwd|pwd|token|api[_-]?key|secret)[\"']?\s{0,4}[=:]\s{0,4}[\"']?)([^\s\"']{5,}[^\s\"'.,;:!?)\]}])")),
    ("key", "AKIA", re.compile(r"(?<!\w)AKIA[A-Z0-9]{16}(?!\w)")),
    ("iban", re.compile(r"[A-Z]{2}\d\d"), re.compile(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ip", re.compile(r"\d\.\d"), re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w)")),
    ("ssn", "-", re.compile(r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])")),
    ("phone", re.compile(r"[+(]\d"), re.compile(r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,4})(?!\w)")),
    ("card", re.compile(r"\d[ -]?\d"), re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)")),
    ("person", re.compile("|".join(MALE + FEMALE)), re.compile(rf"(?<!\w)({'|'.join(sorted(MALE + FEMALE, key=len, reverse=True))})\.?[ ]({_NAME})(?:[ ]({_NAME}))?")),
)


def _luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    digits = re.sub(r"\D", "", found)
    if kind == "card":
        return (len(digits) == 16 and digits[0] in "3456") or _luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "iban":
        return _mod97(found.replace(" ", "")) == 1
    return True


def _script(word: str) -> str:
    c = next((x for x in word if x.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, kind and normal form of every entity, in order and without overlap; earlier kinds win."""
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    for kind, gate, pattern in _PATTERNS:
        if not (gate in text if isinstance(gate, str) else gate.search(text)):
            continue
        for m in pattern.finditer(text):
            if kind == "person":
                gender = "f" if m[1] in FEMALE else "m"
                parts = [(g, "family" if g == 3 or m[3] is None else "given-" + gender) for g in (2, 3) if m[g]]
                spans = [(m.start(g), m.end(g), f"{k}-{_script(m[g])}", m[g].casefold()) for g, k in parts]
            else:
                g = 1 if pattern.groups else 0
                if not _valid(kind, m[g]):
                    continue
                form = m[g].lower() if kind == "email" else re.sub(r"\D", "", m[g]) if kind in ("phone", "card", "ssn") else m[g].replace(" ", "") if kind == "iban" else m[g]
                spans = [(m.start(g), m.end(g), kind, form)]
            if not any(a < spans[-1][1] and spans[0][0] < b for a, b in taken):
                taken.append((spans[0][0], spans[-1][1]))
                found += spans
    names: dict[str, tuple[str, str]] = {}
    for a, b, kind, form in sorted(found):
        if kind.startswith(("given", "family")) and b - a >= 3:
            names.setdefault(text[a:b], (kind, form))
            names.setdefault(text[a:b].upper(), (kind, form))
    if names:  # further mentions of a part of a name, without title
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?!\w)", text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                found.append((m.start(), m.end(), *names[m[0]]))
    return sorted(found)


def _draws(key: bytes, kind: str, form: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.new(key, f"{kind}\0{form}\0{attempt}\0{block}".encode(), hashlib.sha256).digest()
        block += 1


def _pick(draws: Iterator[int], choices) -> str:
    return choices[(next(draws) << 16 | next(draws) << 8 | next(draws)) % len(choices)]


def _like(form: str, draws: Iterator[int], hexadecimal: bool = False) -> str:
    """Every letter and digit replaced by one of its own kind; other characters stay."""
    digits = "0123456789"
    return "".join(_pick(draws, (digits + "abcdef") if hexadecimal and c in "0123456789abcdef" else _PLAIN[c]) if c in _PLAIN else c for c in form)


def surrogate(key: bytes, kind: str, form: str, attempt: int = 0) -> str:
    """Replacement of a normal form; differs from the form itself."""
    while True:
        draws = _draws(key, kind, form, attempt)
        if kind == "email":
            local, _, domain = form.rpartition("@")
            labels = domain.split(".")
            of_domain = _draws(key, "domain", domain, 0)  # addresses of one domain stay together
            out = _like(local, draws) + "@" + ".".join([_like(x, of_domain) for x in labels[:-1]] + labels[-1:])
        elif kind == "ip":
            old = ipaddress.IPv4Address(int.from_bytes(bytes(int(p) for p in form.split(".")), "big"))
            while True:
                new = ipaddress.IPv4Address(int.from_bytes(bytes(next(draws) for _ in range(4)), "big"))
                if old.is_private and not new.is_private:
                    keep = 1 if old.packed[0] in (10, 127) else 2
                    new = ipaddress.IPv4Address(old.packed[:keep] + new.packed[keep:])
                if new.is_private == old.is_private and (old.is_private or new.is_global):
                    break
            out = str(new)
        elif kind == "phone":
            lead = 1 if len(form) == 11 and form[0] == "1" else max(0, len(form) - 10)  # the country code stays
            out = form[:lead] + _pick(draws, "23456789") + _like(form[lead + 1 :], draws)
        elif kind == "card":
            out = form[0] + _like(form[1:], draws)
            if _luhn(form):
                out = next(out[:-1] + c for c in "0123456789" if _luhn(out[:-1] + c))
        elif kind == "iban":
            body = _like(form[4:], draws)
            out = f"{form[:2]}{98 - _mod97(form[:2] + '00' + body):02d}{body}"
        elif kind == "key":
            out = form[:4] + "".join(_pick(draws, _SETS[2] + "234567") for _ in form[4:])
        elif kind == "secret":
            out = _like(form, draws, hexadecimal=re.fullmatch(r"[0-9a-f]+", form) is not None)
        elif kind.startswith(("given", "family")):
            parts, male, female = _NAME_PARTS[kind.rpartition("-")[2]]
            end = parts if kind.startswith("family") else female if kind.startswith("given-f") else male
            out = "".join(_pick(draws, parts) for _ in range(3 + attempt // 8)) + _pick(draws, end)
        else:
            out = _like(form, draws)
        if out != form:
            return out
        attempt += 1 << 20


def _render(mention: str, kind: str, new: str) -> str:
    """The surrogate in the mention's own format."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(new)
        return "".join(next(chars, "") if c.isalnum() else c for c in mention)
    if kind.startswith(("given", "family")):
        return new.upper() if mention.isupper() and len(mention) > 1 else new[:1].upper() + new[1:]
    return new.upper() if kind == "email" and mention.isupper() else new


def _redraw(entity: DataFrame, key: bytes) -> DataFrame:
    def run(batches):
        for x in batches:
            new = [surrogate(key, k, f, a) for k, f, a in zip(*(x.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), pa.array(new, pa.string())], ["kind", "form", "attempt", "new"])

    return entity.select("kind", "form", "attempt").mapInArrow(run, "kind string, form string, attempt int, new string")


def collisions_resolved(forms: DataFrame, key: bytes) -> DataFrame:
    """``kind, form, attempt, new`` for distinct ``kind, form``: surrogates differ from each other and from all forms of their kind."""
    entity = cut(_redraw(forms.withColumn("attempt", F.lit(0)), key))
    while True:
        shared = entity.groupBy("kind", "new").agg(F.min(F.struct(F.xxhash64("form"), "form")).alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1").select("kind", "new", F.col("m.form").alias("first"))
        lost = entity.join(shared, ["kind", "new"]).where("form != first").select("kind", "form")
        real = entity.select("kind", F.col("new").alias("n"), F.col("form").alias("f")).join(entity.select("kind", F.col("form").alias("n")), ["kind", "n"]).select("kind", F.col("f").alias("form"))
        again = cut(lost.unionByName(real).distinct())
        if not again.take(1):
            return entity
        moved = entity.join(again, ["kind", "form"]).withColumn("attempt", F.col("attempt") + 1)
        entity = cut(entity.join(again, ["kind", "form"], "left_anti").unionByName(_redraw(moved, key)))


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input rows and columns with entities replaced in the text, and ``n_entities`` and ``kinds`` (sorted, distinct).

    A null text stays null with no entities; empty texts stay empty. Repeated
    rows are rewritten each and alike. Input columns named ``n_entities`` or
    ``kinds`` are replaced. The key decides all surrogates; whoever lacks it
    cannot link them back.
    """
    base = docs.drop("n_entities", "kinds")

    def find(batches):
        for batch in T.slices(batches, "text"):
            seen = sorted({(k, f) for t in batch.column(0).to_pylist() if t for _, _, k, f in entities(t)})
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.string()) for i in range(2)], ["kind", "form"])

    forms = base.select(F.col(text_col).cast("string").alias("text")).mapInArrow(find, "kind string, form string").distinct()
    second = cut(collisions_resolved(forms, key).where("attempt > 0").select("kind", "form", "attempt"))
    names = base.columns

    def rewrite(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            new: list[str | None] = []
            counts, kinds = [], []
            for t, redrawn in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("__redrawn")).to_pylist()):
                found = entities(t) if t else []
                attempts = {(r["kind"], r["form"]): r["attempt"] for r in redrawn or ()}
                done, out = 0, []
                for a, b, kind, form in found:
                    out += [t[done:a], _render(t[a:b], kind, surrogate(key, kind, form, attempts.get((kind, form), 0)))]
                    done = b
                new.append(None if t is None else "".join([*out, t[done:]]))
                counts.append(len(found))
                kinds.append(sorted({k for _, _, k, _ in found}))
            cols = [pa.array(new, pa.string()) if c == text_col else batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(kinds, pa.list_(pa.string()))], [*names, "n_entities", "kinds"])

    schema = ", ".join(f"`{f.name}` {'string' if f.name == text_col else f.dataType.simpleString()}" for f in base.schema) + ", n_entities long, kinds array<string>"
    none = F.lit(None).cast("array<struct<kind:string,form:string,attempt:int>>")
    if not second.take(1):
        return base.withColumn("__redrawn", none).mapInArrow(rewrite, schema)

    def mentions(batches):
        for batch in T.slices(batches, "text"):
            rows = [(i, k, f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for k, f in sorted({(k, f) for _, _, k, f in entities(t)})]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], x) for j, x in enumerate((pa.int64(), pa.string(), pa.string()))], ["__hash", "kind", "form"])

    # texts are told apart by a hash: equal texts need equal lookups, and an unneeded lookup does no harm
    text_hash = F.xxhash64(F.col(text_col).cast("string"))
    held = base.select(text_hash.alias("h"), F.col(text_col).cast("string").alias("text")).mapInArrow(mentions, "__hash long, kind string, form string").distinct()
    lookup = held.join(second, ["kind", "form"]).groupBy("__hash").agg(F.collect_list(F.struct("kind", "form", "attempt")).alias("__redrawn"))
    return base.withColumn("__hash", text_hash).join(lookup, "__hash", "left").drop("__hash").mapInArrow(rewrite, schema)
