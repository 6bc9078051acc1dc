"""Personal data replaced by keyed surrogates of the same type and form.

Detected entities are brought to a normal form, so that every mention of one
entity meets the same surrogate in all documents (coreference).  A surrogate is
drawn from a keyed hash of the normal form: digits for digits, letters of the
same script and case for letters, valid where the type has a rule (check digit,
octets, title and gender of names).  Distinct entities get distinct surrogates,
and none that is the normal form of a detected entity: proposals that collide
are drawn again, in a job over all distinct entities, until none collides.

A name is one entity whatever title it stands under: a surname's gender is told
by its own ending, a given name's by the titles it has in the whole corpus.
Surrogates of names are held apart by role and script, across genders.  In a
text, words that are a name under a title are that name without one too.
"""

from __future__ import annotations

import hashlib
import hmac
import itertools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import text as tx
from panelwright.session import cut_lineage

#: Draws in the form of the entity; what is still open then gets a wider form with every draw.
SAME_FORM = 8
#: Most replacements that are sent to every task; more are joined by a shuffle.
SENT_ROWS = 500_000

# Titles that announce a name, by gender; first names and surname syllables by script.
TITLES = {
    "m": ("Mr", "Mr.", "Herr", "Monsieur", "Señor", "Sr.", "г-н", "господин", "κύριος"),
    "f": ("Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "г-жа", "госпожа", "κυρία"),
    "n": ("Dr", "Dr.", "Prof.", "Professor"),
}
GIVEN = {
    ("Latin", "m"): "Adam Bruno Carl David Emil Felix Gustav Hugo Ivan Jonas Karl Leo Martin Nils Oscar Paul".split(),
    ("Latin", "f"): "Ada Berta Clara Diana Emma Flora Greta Helena Ida Julia Karla Lena Maria Nora Olga Paula".split(),
    ("Latin", "n"): "Alex Chris Dana Eli Jean Kim Lou Max Noa Robin Sam Toni".split(),
    ("Cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел".split(),
    ("Cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга".split(),
    ("Cyrillic", "n"): "Саша Женя Валя Слава Шура Паша".split(),
    ("Greek", "m"): "Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Νίκος Πέτρος Στέφανος".split(),
    ("Greek", "f"): "Άννα Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("Greek", "n"): "Άγγελος Ιωάννα Κυριακή Χρυσή".split(),
}
SYLLABLES = {
    "Latin": "bar den fel gor hal jen kel lan mor nel par rin sol tam vor wen zel dra".split(),
    "Cyrillic": "бар вел гор дан жел зор кал лен мир нов пар рин сол тар фед шал".split(),
    "Greek": "βαρ γαλ δεν ζορ καλ λαν μαρ νελ παρ ρεν σολ ταρ φελ χαλ".split(),
}
ENDINGS = {("Cyrillic", "m"): "ов", ("Cyrillic", "f"): "ова", ("Cyrillic", "n"): "ко", ("Greek", "m"): "ίδης", ("Greek", "f"): "ίδου", ("Greek", "n"): "ίδη"}

#: Endings by which a surname shows its gender, where its script has any.
SURNAME_FORMS = {
    ("Cyrillic", "f"): ("ова", "ева", "ёва", "ина", "ына", "ая"),
    ("Cyrillic", "m"): ("ов", "ев", "ёв", "ин", "ын", "ий", "ый", "ой"),
    ("Greek", "f"): ("ου",),
    ("Greek", "m"): ("ς", "σ"),  # casefolded
}

_TITLE_GENDER = {t: g for g, titles in TITLES.items() for t in titles}
_TITLE = "|".join(re.escape(t) for t in sorted(_TITLE_GENDER, key=len, reverse=True))
_NAME = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+"
#: Tried in this order at each place; the group that matched names the type.
_PATTERN = re.compile(
    r"(?P<email>[\w.+-]{1,64}@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<key>\bAKIA[0-9A-Z]{16}\b)"
    r"|(?:\b(?:password|passwd|token|secret|api_key)\s?[=:]\s?[\"']?)(?P<secret>[0-9A-Za-z_\-+/]{8,})"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d))"
    r"|(?P<card>(?<![\d-])\d{4}(?:[ -]?\d{4}){3}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}\b|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}\b)"
    rf"|(?<!\w)(?P<title>{_TITLE}) (?P<name>{_NAME}(?: {_NAME}){{0,2}})"
)
_WORD = re.compile(r"(?<!\w)[^\W\d_]++(?!\w)")
_HINT = re.compile(r"[\d@]|password|passwd|token|secret|api_key|" + _TITLE)


@dataclass(frozen=True)
class Mention:
    """Characters [begin, end) of a text are an entity of ``kind`` with normal form ``norm``."""

    begin: int
    end: int
    kind: str
    norm: str


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN").split(" ")[0].title()
    return name if name in SYLLABLES else "Latin"


def surname_gender(norm: str, script: str) -> str:
    """The gender that a surname's ending shows, 'n' where it shows none."""
    return next((g for (s, g), ends in SURNAME_FORMS.items() if s == script and norm.endswith(ends)), "n")


def _bare_names(text: str, found: list[Mention]) -> list[Mention]:
    """Capitalised words outside ``found`` that are a name under a title in the same text."""
    names: dict[str, str] = {}
    for m in found:
        if m.kind.startswith(("given", "surname")):
            names.setdefault(m.norm, m.kind)
    if not names:
        return []
    out, k = [], 0
    for w in _WORD.finditer(text):
        while k < len(found) and found[k].end <= w.start():
            k += 1
        norm = w.group().casefold()
        if norm in names and w.group()[0].isupper() and (k == len(found) or w.end() <= found[k].begin):
            out.append(Mention(w.start(), w.end(), names[norm], norm))
    return out


def find_mentions(text: str) -> list[Mention]:
    """Entities of a text from left to right, without overlaps."""
    if not _HINT.search(text):
        return []
    out: list[Mention] = []
    for m in _PATTERN.finditer(text):
        kind = m.lastgroup
        begin, end = m.span(kind)
        found = text[begin:end]
        if kind == "name":
            gender, words = _TITLE_GENDER[m.group("title")], list(re.finditer(r"\S+", found))
            for k, w in enumerate(words):
                norm, script = w.group().casefold(), script_of(w.group())
                kind = f"surname_{script}_{surname_gender(norm, script)}" if k == len(words) - 1 else f"given_{script}_{gender}"
                out.append(Mention(begin + w.start(), begin + w.end(), kind, norm))
        elif kind == "ip":
            if all(int(x) < 256 for x in found.split(".")):
                out.append(Mention(begin, end, kind, found))
        elif kind in ("phone", "card", "ssn"):
            out.append(Mention(begin, end, kind, re.sub(r"\D", "", found)))
        elif kind == "email":
            found = found.rstrip(".-")
            out.append(Mention(begin, begin + len(found), kind, found.casefold()))
        else:
            out.append(Mention(begin, end, kind, found))
    return sorted([*out, *_bare_names(text, out)], key=lambda m: m.begin)


class Draw:
    """Numbers from a keyed hash of (kind, normal form, draw)."""

    def __init__(self, key: bytes, kind: str, norm: str, draw: int) -> None:
        self._key, self._seed, self._block, self._left = key, f"{kind}\0{draw}\0{norm}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self._left) < 4:
            self._left += hmac.new(self._key, self._seed + b"\0%d" % self._block, hashlib.sha256).digest()
            self._block += 1
        value, self._left = int.from_bytes(self._left[:4], "big"), self._left[4:]
        return value * n >> 32

    def like(self, text: str) -> str:
        """Random characters of the same class: digit, hexadecimal word, upper and lower case letter."""
        letters = "abcdef" if re.fullmatch(r"(?=.*\d)[0-9a-f]+", text) else "abcdefghijklmnopqrstuvwxyz"

        def one(c: str) -> str:
            if c.isdigit():
                return str(self.below(10))
            if c.isalpha():
                new = letters[self.below(len(letters))]
                return new.upper() if c.isupper() else new
            return c

        return "".join(map(one, text))


def luhn_valid(digits: str) -> bool:
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def surrogate(key: bytes, kind: str, norm: str, draw: int = 0) -> str:
    """The normal form of the replacement of an entity, at its ``draw``-th proposal.

    From draw ``SAME_FORM`` on the form widens: any octets, more letters in mail
    addresses and secrets, more digits in numbers.  Cards and keys have room for
    10^14 and more as they are.
    """
    d = Draw(key, kind, norm, draw)
    more = max(draw - SAME_FORM + 1, 0)
    if kind == "email":
        name, _, domain = norm.partition("@")
        host, dot, top = domain.rpartition(".")
        in_name = min(more, max(64 - len(name), 0))  # a longer one is no address
        return f"{d.like(name + 'x' * in_name)}@{d.like(host + 'x' * (more - in_name))}{dot}{top}"
    if kind == "ip":
        octets = []
        for part in norm.split("."):
            low, high = (0, 255) if more else (0, 9) if len(part) == 1 else (10, 99) if len(part) == 2 else (100, 255)
            octets.append(str(low + d.below(high - low + 1)))
        return ".".join(octets)
    if kind == "card":
        body = norm[0] + d.like(norm[1:-1])
        last = next(x for x in "0123456789" if luhn_valid(body + x))
        return body + (last if luhn_valid(norm) else str((int(last) + 1 + d.below(9)) % 10))
    if kind == "phone":
        area = max(len(norm) - 10, 0)  # what precedes ten digits is the country
        return norm[:area] + str(2 + d.below(8)) + d.like(norm[area + 1 :] + "0" * more)
    if kind == "key":
        return norm[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[d.below(32)] for _ in norm[4:])
    if kind.startswith(("given", "surname")):
        role, script, gender = kind.split("_")
        if role == "given":
            names = GIVEN[script, gender]
            name = names[d.below(len(names))]
            # longer with every draw, so that no number of entities uses the names up
            return "".join([name, *(names[d.below(len(names))] for _ in range(draw))]).casefold()
        parts = [SYLLABLES[script][d.below(len(SYLLABLES[script]))] for _ in range(2 + draw)]
        return "".join(parts) + ENDINGS.get((script, gender), "")
    return d.like(norm + ("0" if kind == "ssn" else "x") * more)


def rendered(original: str, kind: str, new: str) -> str:
    """Writes a surrogate in the form of a mention: its separators and its case."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(new)
        same = "".join(next(digits) if c.isdigit() else c for c in original)
        return same + "".join(digits)  # of a wider form the rest
    if kind == "email" or kind.startswith(("given", "surname")):
        if original.isupper():
            return new.upper()
        return new[:1].upper() + new[1:] if original[:1].isupper() else new
    return new


_MENTIONS = "array<struct<begin:int,end:int,kind:string,norm:string>>"


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_hash, mentions) of every text that has a mention, once per different text."""
    hashed = docs.select(F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("norm", pa.string())]))

    def find(texts: pa.Array) -> tuple[np.ndarray, dict[str, object]]:
        found = [find_mentions(t) if t else [] for t in texts.to_pylist()]
        rows = np.flatnonzero([bool(f) for f in found])
        return rows, {"mentions": pa.array([[vars(m) for m in found[i]] for i in rows], kind)}

    return tx.map_texts(hashed, "text", find, f"mentions {_MENTIONS}", keep=["text_hash"])


def _scope(kind: Column) -> Column:
    """Within what surrogates differ: the type, of names the role and script."""
    return F.regexp_replace(kind, "^((?:given|surname)_[^_]+)_.*$", "$1")


def one_kind_per_name(single: DataFrame) -> DataFrame:
    """Mentions with the gender of a given name taken from all its titles: the one they show, else 'n'."""
    is_given = F.col("kind").startswith("given_")
    part = lambda i: F.get(F.split("kind", "_"), F.lit(i))
    given = single.where(is_given).withColumn("_script", part(1))
    shown = F.array_remove(F.collect_set(part(2)), "n")
    genders = given.groupBy("_script", "norm").agg(F.when(F.size(shown) == 1, F.get(shown, F.lit(0))).otherwise("n").alias("_gender"))
    kind = F.concat(F.lit("given_"), F.col("_script"), F.lit("_"), F.col("_gender"))
    told = given.join(genders, ["_script", "norm"]).withColumn("kind", kind)
    return single.where(~is_given).union(told.select(*single.columns))


def assign(entities: DataFrame, key: bytes, most_draws: int | None = None) -> DataFrame:
    """(kind, norm, surrogate) for distinct (kind, norm): distinct surrogates, none of them a detected entity.

    Each round draws for the entities that have none yet; of equal proposals the
    smallest normal form's is taken, and proposals already taken are dropped.
    Names are compared by role and script, whatever their gender.  Forms without
    room widen, so the rounds end; only with ``most_draws`` they end with an error.
    """

    def draw(rows: DataFrame, number: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = [surrogate(key, k, n, number) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], names=["kind", "norm", "surrogate"])

        return rows.select("kind", "norm").mapInArrow(run, "kind string, norm string, surrogate string")

    scope = _scope(F.col("kind")).alias("scope")
    originals = entities.select(scope, F.col("norm").alias("surrogate")).distinct()
    taken: DataFrame | None = None
    open_ = entities
    for number in itertools.count() if most_draws is None else range(most_draws):
        proposed = draw(open_, number).select("*", scope).join(originals, ["scope", "surrogate"], "left_anti")
        if taken is not None:
            proposed = proposed.join(taken.select(scope, "surrogate"), ["scope", "surrogate"], "left_anti")
        won = proposed.groupBy("scope", "surrogate").agg(F.min(F.struct("norm", "kind")).alias("e")).select("e.kind", "e.norm", "surrogate")
        taken = cut_lineage(won if taken is None else taken.union(won))
        open_ = cut_lineage(open_.select("kind", "norm").join(taken, ["kind", "norm"], "left_anti"))
        if open_.isEmpty():
            return taken
    raise ValueError(f"no distinct surrogate within {most_draws} draws for {open_.count()} entities: their form has no room")


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Every row with the entities of its text replaced, and n_entities, kinds (sorted, distinct).

    The same entity has the same surrogate in all rows, different entities have
    different ones.  Null and empty texts, and texts without entities, stay as
    they are with n_entities 0.  Equal rows stay equal rows.  Input columns named
    like a result are replaced.
    """
    found = cut_lineage(mentions(docs, text_col).dropDuplicates(["text_hash"]))
    single = found.select("text_hash", F.explode("mentions").alias("m")).select("text_hash", "m.*")
    single = cut_lineage(one_kind_per_name(single))
    table = assign(cut_lineage(single.select("kind", "norm").distinct()), key.encode())
    done = single.join(table, ["kind", "norm"]).groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "kind", "surrogate"))).alias("_new"))
    done = cut_lineage(done.withColumnRenamed("text_hash", "_hash"))
    small = (done.agg(F.sum(F.size("_new"))).first()[0] or 0) <= SENT_ROWS
    rows = docs.drop(*[c for c in ("n_entities", "kinds") if c != text_col]).withColumn("_key", F.xxhash64(F.col(f"`{text_col}`")))
    joined = rows.join(F.broadcast(done) if small else done, F.col("_key") == F.col("_hash"), "left").drop("_key", "_hash")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            texts = batch.column(place).to_pylist()
            for i, new in enumerate(batch.column("_new").to_pylist()):
                if not new or texts[i] is None:
                    continue
                parts, at = [], 0
                for m in new:
                    parts += [texts[i][at : m["begin"]], rendered(texts[i][m["begin"] : m["end"]], m["kind"], m["surrogate"])]
                    at = m["end"]
                texts[i] = "".join([*parts, texts[i][at:]])
            yield batch.set_column(place, text_col, pa.array(texts, batch.column(place).type))

    out = joined.mapInArrow(write, joined.schema)
    n = F.when(F.col("_new").isNull(), F.lit(0)).otherwise(F.size("_new")).cast("long")
    kinds = F.coalesce(F.array_sort(F.array_distinct(F.col("_new.kind"))), F.array().cast("array<string>"))
    return out.withColumns({"n_entities": n, "kinds": kinds}).drop("_new")
