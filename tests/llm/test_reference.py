import random
import re
import time

import pytest

from corpusloom.llm.reference import OTHER, Trie, Words, allowed, candidates, readings, resolve, shortened, simplified
from corpusloom.session import Scratch

ENTRIES = [
    (0, "zobrudaul_schnauzer", ["ivory howler"]), (1, "mumbskusa_pointer", ["marsh wader", "soandtuto shepherd", "MBAPR"]), (2, "mumbskusa_setter", []), (3, "balafau_terrier", []),
    (4, "jethbanex_spitz", ["JHXSZ"]), (5, "kuwoaxvilk_mastiff", None), (6, "drugapor_hound", []), (7, "woadrebrau_laika", []), (8, "roamqedre_retriever", []), (9, "himskondmu_bulldog", ["amber jumper"]),
]

MEANT = {
    "Zobrudaul Schnauzer": 0, "SCHNAUZER (zobrudaul)": 0, "zobrudaul": 0, "Zobrduaul_Schnuazer": 0, "n12345678-zobrudaul schnauzer": 0, "1207-n483481-zobrudaul": 0, "zobr. schnauzer": 0, "zobrudaul schn": 0,
    "Ivory Howler dog": 0, "ivory_hower": 0, "M.B.A.P.R.": 1, "M B A P R": 1, "mbapr": 1, "mum6skusa-pointer [sic]": 1, "Murnbskusa Pointer": 1, "marsh-wader #2": 1, "soandtuto_shepherd": 1,
    "mumbskusa str.": 2, "my mumbskusa setter, 3 yrs": 2, "MUMBSKUSA SETTER": 2, "mumb­skusa setter": 2, "ｂａｌａｆａｕ ｔｅｒｒｉｅｒ": 3, "Bаlafаu terrier?": 3, "bálafau_terrier!!": 3, "BalafauTerrier": 3,
    "terrier, balafau puppy": 3, "jethbanex": 4, "JHXSZ dog": 4, "photo of kuwo. mastiff": 5, "drugap-or.hound": 6, "drugapor hnd": 6, "laika/woadrebrau (male)": 7, "roamqedre_rtrvr.": 8, "himskondmu bull dog": 9, "Amber  Jumper": 9, "himskondmu bdog": 9,
}
NONE = [
    "terrier", "small terrier", "some kind of spitz", "spitz_00", "mumbskusa", "balafau spitz", "jethbanex laika", "zobrudaul schnauzer x balafau terrier", "half balafau terrier half drugapor hound", "balafau & drugapor", "balafau terrier mix",
    "drugapor-hound / balafau terrier", "unknown", "n/a", "", "   ", "​", "cat?", "puppy", "yeikorleil setter", "mumbskusa laika", "soandtuto spitz", "12345", "???", "QQQQQ", "z" * 20000, "MBAPX",
]


@pytest.fixture(scope="module")
def trie():
    return Trie(ENTRIES)


@pytest.mark.parametrize(("value", "entry"), MEANT.items())
def test_meant(trie, value, entry):
    assert trie.meaning(value)[0] == entry


@pytest.mark.parametrize("value", NONE)
def test_no_entry(trie, value):
    assert trie.meaning(value)[0] is None


def distance(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def all_forms(listed_entries):
    """Every form of every entry, one by one, with the errors it may have."""
    forms = {}

    def add(form, entry, errors=None):
        errors = allowed(len(form)) if errors is None else min(errors, allowed(len(form)))
        ends = forms.setdefault(form, {})
        ends[entry] = max(errors, ends.get(entry, 0))

    entries = [(i, simplified(n), [simplified(a) for a in aliases or [] if a]) for i, n, aliases in listed_entries]
    split = lambda s: [w for w in re.split(r"[\W_]+", s) if w]
    names = [(i, split(n)) for i, n, _ in entries if split(n)]
    aliases = [(i, split(a)) for i, _, own in entries for a in own if split(a)]
    kinds = {w[-1] for _, w in names if len(w) > 1}
    listed = {("".join(w[:-1]), w[-1]) for _, w in names + aliases}
    firsts: dict[str, set[int]] = {}
    for i, w in names:
        firsts.setdefault(w[0], set()).add(i)
    kind_forms = {k: shortened(k) for k in kinds}
    for i, words in names + aliases:
        first, last = "".join(words[:-1]), words[-1]
        add("".join(words), i)
        if len(words) == 1:
            continue
        add(last + first, i)
        if last in kinds:
            for short in kind_forms[last]:
                add(first + short, i, 1 if len(short) > 3 and len(first) > 5 else 0)
                add(short + first, i, 0)
            for k in range(4, len(first)):
                for kind in (last, *kind_forms[last]):
                    add(first[:k] + kind, i, 0)
                    add(kind + first[:k], i, 0)
            for kind in kinds:
                if (first, kind) in listed:
                    continue
                for other in (kind, *kind_forms[kind]):
                    add(first + other, OTHER, None if other == kind else 0)
                add(kind + first, OTHER)
    for i, words in names:
        if len(words) > 1:
            add(words[0], i if len(firsts[words[0]]) == 1 else OTHER)
    for kind in kinds:
        for form in (kind, *kind_forms[kind]):
            add(form, OTHER, None if form == kind else 0)
    outright = {}
    for i, words in names + aliases:
        outright.setdefault("".join(words), set()).add(i)
    for form, own in outright.items():
        forms[form] = dict.fromkeys(own, allowed(len(form)))
    return forms


def test_automaton_equals_distances(trie):
    rng = random.Random(1)
    every = all_forms(ENTRIES)
    forms = sorted(every)
    for n in range(120):
        word = list(rng.choice(forms))
        for _ in range(rng.randint(n % 4 and 1, 3)):
            at = rng.randrange(len(word) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                word.insert(at, rng.choice("abcxyz"))
            elif kind == 1 and len(word) > 2:
                del word[at - 1]
            elif kind == 2:
                word[at - 1] = rng.choice("abcxyz")
            elif 0 < at < len(word):
                word[at - 1], word[at] = word[at], word[at - 1]
        word = "".join(word)
        want = {(distance(f, word), e) for f in forms if abs(len(f) - len(word)) <= 2 for e, k in every[f].items() if distance(f, word) <= min(k, 2)}
        assert set(trie.search(word)) == want


def test_forms_have_bounded_errors(trie):
    assert all(errors <= allowed(len(form)) for form, ends in trie.whole.items() for errors in ends.values())
    assert all(trie.exactly(form) == set(ends) for form, ends in all_forms(ENTRIES).items())
    assert readings("ab x cd") == [("abxcd", 0)] and readings("A. x B") == [("axb", 2)]


def test_resolve(spark):
    rows = [("Balafau Terrier",), ("Balafau Terrier",), (None,), ("",), ("terrier",)]
    values = spark.createDataFrame(rows, "v string")
    entries = spark.createDataFrame([*ENTRIES, (None, "x_y", []), (11, None, []), (12, "", [None])], "breed_id int, canonical_label string, aliases array<string>")
    got = {r.v: r.breed_id for r in resolve(values, "v", entries, Scratch(spark, "r")).collect()}
    assert got == {"Balafau Terrier": 3, "": None, "terrier": None}
    assert resolve(values.limit(0), "v", entries, Scratch(spark, "r")).count() == 0
    assert resolve(values, "v", entries.limit(0), Scratch(spark, "r")).filter("breed_id IS NOT NULL").count() == 0


def test_all_entries_within_the_distance(spark, trie):
    entries = spark.createDataFrame([*ENTRIES, (20, "zobrudaut_schnauzer", [])], "breed_id int, canonical_label string, aliases array<string>")
    values = spark.createDataFrame([("Zobrudaul Schnauzer",), ("zobrudauk schnauzer",), ("qqqqqqq",), ("",), (None,)], "v string")
    got = {tuple(r) for r in candidates(values, "v", entries, Scratch(spark, "r")).collect()}
    assert got == {("Zobrudaul Schnauzer", 0, 0), ("Zobrudaul Schnauzer", 20, 1), ("zobrudauk schnauzer", 0, 1), ("zobrudauk schnauzer", 20, 1)}
    # equally near to two: none is meant
    meant = {r.v: r.breed_id for r in resolve(values, "v", entries, Scratch(spark, "r")).collect()}
    assert meant["Zobrudaul Schnauzer"] == 0 and meant["zobrudauk schnauzer"] is None


def test_words_are_a_parameter():
    cities = Trie([(1, "new york", ["big apple"]), (2, "los angeles", [])], Words(decoration=frozenset({"city"}), joining=frozenset({"to"})))
    assert cities.meaning("New York City")[0] == 1 and cities.meaning("Los Angelse")[0] == 2
    assert cities.meaning("new york to los angeles")[0] is None and cities.meaning("my new york")[0] is None and cities.meaning("the big, old new york")[0] is None


def test_many_entries_load_and_are_found():
    rng = random.Random(7)
    part = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n))
    kinds = [part(3) for _ in range(200)]
    entries = [(i, f"{part(4)}_{rng.choice(kinds)}", [part(2) + " " + part(3)]) for i in range(20_000)]
    start = time.time()
    trie = Trie(entries)
    assert time.time() - start < 30
    for i, name, _ in rng.sample(entries, 50):
        first, kind = name.split("_")
        entry = trie.meaning(f"{kind} {first}")[0]
        assert entry == i or entry is None or len(trie.listed[first, kind]) > 1
        assert i in {e for _, e in trie.search(first + kind[:-1])} | {e for _, e in trie.search(first + kind)}
