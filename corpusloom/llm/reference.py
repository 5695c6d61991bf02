"""Problem 3: free-entered values mapped to a canonical list.

Method: a trie of the reference entries, alias and short forms included, is searched with a
Levenshtein automaton (transpositions count one): the automaton of the typed value, a bit per
position and an integer per number of errors, runs down the trie and gives all entries within a distance
that depends on the length of their form. The trie also holds what is no entry: kinds alone, and first
words of entries with a kind that makes them another breed; a value nearest to such a form, or equally
near to two entries, means none.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.lookalikes import LOOK_ALIKES
from corpusloom.operators.skew import skew_join
from corpusloom.session import Scratch, let_workers_import

#: The reference list is read to the driver; a longer one is refused.
MAX_ENTRIES = 20_000


@dataclass(frozen=True)
class Words:
    """What the values of one field may have about an entry: words that decorate it, words that join two, digits written for letters."""

    decoration: frozenset[str] = frozenset()
    joining: frozenset[str] = frozenset()
    digits: tuple[str, str] = ("", "")


# The words of breed labels, the default of what follows.
BREEDS = Words(
    frozenset("a adult breed dog dogs f female image img kind m male my of old photo pic picture pup puppies puppy pure purebred sic small some the type yr yrs year years young".split()),
    frozenset("and cross crossed half mix mixed or plus vs with x".split()),
    ("01568", "olsbb"),
)
OTHER = -1


def allowed(length: int) -> int:
    """Errors within which a form of this length is found."""
    return 0 if length <= 5 else 1 if length <= 8 else 2


def simplified(value: str) -> str:
    """Lower-case letters, digits and separators: without accents, invisible characters, look-alikes and full-width forms."""
    text = "".join(LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFKD", value) if unicodedata.category(c) not in ("Mn", "Cf"))
    return "".join(LOOK_ALIKES.get(c, c) for c in text).replace("&", " and ").replace("+", " and ").lower()


def readings(value: str, about: Words = BREEDS) -> list[tuple[str, int]]:
    """The letters that a typed value may mean, without decoration, each with the errors it may have.

    What seems to join several breeds may only be a breed with a blank too many, so it must fit exactly.
    """
    spaced = re.sub(r"(?<![^\W_])([^\W\d_](?:[\W_]+[^\W\d_](?![^\W_])){2,})", lambda m: re.sub(r"[\W_]", "", m[1]), simplified(value))
    words = [w for w in re.split(r"[\W_]+", spaced) if w]
    words = [w.translate(str.maketrans(*about.digits)) if sum(c.isalpha() for c in w) > 2 else w for w in words if not re.fullmatch(r"n?\d+", w)]
    letters = lambda ws: "".join(c for c in "".join(ws) if c.isalpha())
    if about.joining & set(words):
        return [(letters(words), 0)]
    plain = [w for w in words if w not in about.decoration]
    kept = [w for w in words if w not in about.decoration or w in ("dog", "dogs")]
    return [(w, 2) for w in dict.fromkeys((letters(plain), letters(kept))) if w]


def shortened(word: str) -> set[str]:
    """What people write for a word to save letters: its beginning, its consonants, its first letter and a last syllable."""
    out = {word[:k] for k in range(3, len(word))}
    bare = word[0] + re.sub("[aeiou]", "", word[1:])
    out |= {bare, re.sub(r"(.)\1+", r"\1", bare)}
    for end in ("dog", "herd"):
        if word.endswith(end):
            out.add(word[0] + end)
    return {w for w in out if len(w) >= 3 and w != word}


def _tree(forms: Iterable[tuple[str, list]]) -> dict:
    """A trie of (form, what ends there)."""
    root: dict = {}
    for form, ends in forms:
        node = root
        for c in form:
            node = node.setdefault(c, {})
        node[""] = ends
    return root


class Trie:
    """The forms of all entries, factored: a trie of the words that precede a kind, one of the kinds, and one of whole forms.

    The automaton crosses from the end of a first word to the kinds and from the end of a kind to the first words, so that
    their combinations, which are as many as entries times kinds, are never stored. Nodes are dicts from letter to node; ""
    holds what ends there.
    """

    def __init__(self, entries: Iterable[tuple[int, str, list[str]]], about: Words = BREEDS):
        self.about = about
        entries = [(i, simplified(n), [simplified(a) for a in aliases or [] if a]) for i, n, aliases in entries]
        split = lambda s: [w for w in re.split(r"[\W_]+", s) if w]
        names = [(i, split(n)) for i, n, _ in entries if split(n)]
        every = names + [(i, split(a)) for i, _, own in entries for a in own if split(a)]
        kinds = {w[-1] for _, w in names if len(w) > 1}
        self.listed: dict[tuple[str, str], set[int]] = {}  # the entries called by a first word and a kind
        self.outright: dict[str, set[int]] = {}  # what an entry is called outright beats every short form
        self.whole: dict[str, dict[int, int]] = {}  # form, entry, errors it may have
        alone: dict[str, set[int]] = {}
        for i, w in names:
            alone.setdefault(w[0], set()).add(i)
        for i, words in every:
            first, last = "".join(words[:-1]), words[-1]
            self.outright.setdefault(first + last, set()).add(i)
            self._add(first + last, i)
            if first and last in kinds:
                self.listed.setdefault((first, last), set()).add(i)
            elif first:
                self._add(last + first, i)
        for i, words in names:
            if len(words) > 1:
                self._add(words[0], i if len(alone[words[0]]) == 1 else OTHER)
        self.kinds: dict[str, list[tuple[str, bool]]] = {}  # form, the kinds it stands for, whether in full
        for kind in sorted(kinds):
            for form in (kind, *sorted(shortened(kind))):
                self.kinds.setdefault(form, []).append((kind, form == kind))
                self._add(form, OTHER, None if form == kind else 0)
        self.beginnings: dict[str, list[str]] = {}  # of first words
        self.firsts = {first for first, _ in self.listed}
        # first words with a kind that isn't theirs name another breed, also those of names whose own last word is no kind
        self.firsts |= {"".join(w[:-1]) for _, w in every if len(w) > 1 and w[-1] in kinds}
        for first in sorted(self.firsts):
            for k in range(4, len(first)):
                self.beginnings.setdefault(first[:k], []).append(first)
        for form, own in self.outright.items():
            self.whole[form] = dict.fromkeys(own, allowed(len(form)))
        # only what may have errors is searched: kinds in any form but the shortest after a first word, kinds in full before one
        ends = {f: [(kind, full, f) for kind, full in of] for f, of in self.kinds.items()}
        whole, firsts = ((f, list(e.items())) for f, e in self.whole.items()), ((f, [f]) for f in self.firsts)
        after = ((f, own) for f, e in ends.items() if (own := [x for x in e if x[1] or len(f) > 3]))
        before = ((f, own) for f, e in ends.items() if (own := [x for x in e if x[1]]))
        self.roots = [_tree(forms) for forms in (whole, firsts, after, before)]

    def _add(self, form: str, entry: int, errors: int | None = None) -> None:
        errors = allowed(len(form)) if errors is None else min(errors, allowed(len(form)))
        ends = self.whole.setdefault(form, {})
        ends[entry] = max(errors, ends.get(entry, 0))

    def _joined(self, first: str, form: str, kind: str, full: bool, kind_first: bool) -> list[tuple[int, int]]:
        """(entry, allowed errors) of a first word and a form of a kind, in this order or the other."""
        whole = form + first if kind_first else first + form
        if whole in self.outright:
            return []  # found as a whole
        most, own = allowed(len(whole)), self.listed.get((first, kind))
        if own:
            errors = most if full else min(most, 1) if not kind_first and len(form) > 3 and len(first) > 5 else 0
            return [(i, errors) for i in own]
        if kind_first and not full:
            return []
        return [(OTHER, most if full else 0)]

    def exactly(self, word: str) -> set[int]:
        """The entries of the forms that are ``word``."""
        if word in self.outright:
            return self.outright[word]
        found = set(self.whole.get(word, ()))
        for p in range(1, len(word)):
            for first, form, kind_first in ((word[:p], word[p:], False), (word[p:], word[:p], True)):
                for kind, full in self.kinds.get(form, ()):
                    if first in self.firsts:
                        found |= {e for e, _ in self._joined(first, form, kind, full, kind_first)}
                    for whole in self.beginnings.get(first, ()):
                        found |= self.listed.get((whole, kind), set())
        return found

    def search(self, word: str, most: int = 2) -> list[tuple[int, int]]:
        """All (errors, entry) of forms within their allowed distance of ``word``; an entry comes once for each of its forms."""
        found = [(0, e) for e in self.exactly(word)]
        most = min(most, allowed(len(word) + most))
        size = len(word)
        masks: dict[str, int] = {}
        for p, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << p
        accept, full = 1 << size, (1 << size + 1) - 1
        # bit p of state e: the form so far reads the first p letters of the word with e errors
        start = [(1 << e + 1) - 1 & full for e in range(most + 1)]
        stack: list[tuple] = [(self.roots[tree], start, None, 0, tree, None) for tree in (0, 1, 3)]
        while stack:
            node, state, before, last, tree, joined = stack.pop()
            for c, child in node.items():
                if c == "":
                    if joined is None and tree == 1:
                        stack += [(self.roots[2], state, before, last, 2, first) for first in child]
                    elif tree == 3:
                        stack.append((self.roots[1], state, before, last, 1, child))
                    errors = next((e for e, bits in enumerate(state) if bits & accept), None)
                    if errors is None:
                        continue
                    if tree == 0:
                        ends = child
                    elif joined is None:
                        continue
                    elif tree == 2:
                        ends = [x for kind, whole, form in child for x in self._joined(joined, form, kind, whole, False)]
                    else:
                        ends = [x for first in child for kind, whole, form in joined for x in self._joined(first, form, kind, whole, True)]
                    found += [(errors, entry) for entry, may in ends if errors <= may]
                    continue
                mask = masks.get(c, 0)
                below, new = 0, []
                for e, bits in enumerate(state):
                    now = (bits & mask) << 1
                    if e:
                        now |= state[e - 1] | state[e - 1] << 1 | below << 1
                        if before is not None:  # the last two letters stand the other way round in the word
                            now |= ((before[e - 1] & mask) << 1 & last) << 1
                    new.append(now & full)
                    below = new[-1]
                if new[-1]:
                    stack.append((child, new, state, mask, tree, joined))
        return found

    def meaning(self, value: str | None) -> tuple[int | None, int | None]:
        """(entry, errors) that ``value`` means, (None, errors) if the nearest form is no entry or several are."""
        if value is None:
            return None, None
        best: list[tuple[int, int]] = []
        for letters, most in readings(value, self.about):
            if ends := self.exactly(letters):  # nothing is nearer
                best += [(0, e) for e in ends]
            else:
                best += self.search(letters, most)
        if not best:
            return None, None
        errors = min(e for e, _ in best)
        entries = {entry for e, entry in best if e == errors}
        entry = entries.pop() if len(entries) == 1 else OTHER
        return (None if entry == OTHER else entry), errors


    def within(self, value: str | None) -> dict[int, int]:
        """Every entry within the distance of what ``value`` may read, with its fewest errors."""
        found: dict[int, int] = {}
        for letters, most in readings(value, self.about) if value is not None else []:
            for errors, entry in self.search(letters, most):
                if entry != OTHER:
                    found[entry] = min(errors, found.get(entry, errors))
        return found


_TRIES: dict[tuple[str, Words], Trie] = {}


def _trie(entries: str, about: Words) -> Trie:
    if (entries, about) not in _TRIES:
        _TRIES.clear()
        _TRIES[entries, about] = Trie(map(tuple, json.loads(entries)), about)
    return _TRIES[entries, about]


def _searched(values: DataFrame, column: str, reference: DataFrame) -> tuple[DataFrame, str]:
    """(the different non-null values, spread over tasks, and the entries of ``reference`` as JSON)."""
    let_workers_import(values.sparkSession)
    rows = reference.select("breed_id", "canonical_label", "aliases").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    entries = json.dumps(sorted([r[0], r[1], sorted(a for a in r[2] or [] if a)] for r in rows if r[0] is not None and r[1]))
    different = values.filter(F.col(column).isNotNull()).select(column).distinct()
    # the search is what takes time, so the values are spread whatever their bytes
    return different.repartition(max(values.sparkSession.sparkContext.defaultParallelism, 8)), entries


def candidates(values: DataFrame, column: str, reference: DataFrame, scratch: Scratch, about: Words = BREEDS) -> DataFrame:
    """(column, breed_id, errors) of each different non-null value of ``column`` with EVERY entry within the distance, by its nearest form."""
    different, entries = _searched(values, column, reference)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = _trie(entries, about)
        for frame in frames:
            found = [(v, entry, errors) for v in frame[column] for entry, errors in sorted(trie.within(v).items())]
            yield pd.DataFrame(found, columns=[column, "breed_id", "errors"]).astype({"breed_id": "int32", "errors": "int32"})

    return scratch.put(different.mapInPandas(run, f"`{column}` string, breed_id int, errors int"), f"candidates-{column}")


def resolve(values: DataFrame, column: str, reference: DataFrame, scratch: Scratch, about: Words = BREEDS) -> DataFrame:
    """(column, breed_id, errors) of each different non-null value of ``column``.

    breed_id is null where the value means no entry of ``reference`` (breed_id, canonical_label, aliases),
    errors null where nothing is near. Empty and very long values mean none; entries without id or name are left out.
    """
    different, entries = _searched(values, column, reference)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = _trie(entries, about)
        for frame in frames:
            found = [trie.meaning(v) for v in frame[column]]
            frame["breed_id"] = pd.array([f[0] for f in found], dtype="Int32")
            frame["errors"] = pd.array([f[1] for f in found], dtype="Int32")
            yield frame

    return scratch.put(different.mapInPandas(run, f"`{column}` string, breed_id int, errors int"), f"resolved-{column}")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every label that means an entry of the list, with that entry."""
    taxonomy = spark.read.parquet(f"{sf}/taxonomy.parquet").select("label_id", "original_label")
    meant = resolve(taxonomy, "original_label", spark.read.parquet(f"{sf}/breed_list.parquet"), Scratch(spark, "p3"))
    return skew_join(taxonomy, meant.filter("breed_id IS NOT NULL"), "original_label").filter("label_id IS NOT NULL").select("label_id", "breed_id").distinct()


def p3_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every different original_breed of the manifest with its rows and entry; without entry it is reported as unmatched."""
    breeds = spark.read.parquet(f"{sf}/breed_list.parquet")
    manifest = spark.read.parquet(f"{sf}/master_manifest.parquet").select("original_breed")
    counts = manifest.groupBy("original_breed").agg(F.count(F.lit(1)).alias("rows"))
    counts = (scratch := Scratch(spark, "p3")).put(counts, "counts")
    meant = resolve(counts, "original_breed", breeds, scratch)
    out = counts.join(meant, "original_breed", "left").join(F.broadcast(breeds.select("breed_id", "canonical_label").limit(MAX_ENTRIES)), "breed_id", "left")
    return out.select("original_breed", "rows", "breed_id", "canonical_label", "errors", F.when(F.col("breed_id").isNull(), "unmatched").otherwise("matched").alias("status"))


def p3_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every different original_label of the taxonomy with its labels and entry; without entry it is reported as unmatched."""
    labels = spark.read.parquet(f"{sf}/taxonomy.parquet").select("label_id", "original_label").distinct()
    counts = (scratch := Scratch(spark, "p3")).put(labels.groupBy("original_label").agg(F.count("label_id").alias("labels")), "counts")
    meant = resolve(counts, "original_label", spark.read.parquet(f"{sf}/breed_list.parquet"), scratch)
    out = counts.join(meant, "original_label", "left")
    return out.select("original_label", "labels", "breed_id", "errors", F.when(F.col("breed_id").isNull(), "unmatched").otherwise("matched").alias("status"))


def p3_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry within the distance of each different original_label, with its errors."""
    taxonomy = spark.read.parquet(f"{sf}/taxonomy.parquet").select("original_label")
    return candidates(taxonomy, "original_label", spark.read.parquet(f"{sf}/breed_list.parquet"), Scratch(spark, "p3"))


QUERIES = {"p3_found": p3_found, "p3_values": p3_values, "p3_labels": p3_labels, "p3_candidates": p3_candidates}
