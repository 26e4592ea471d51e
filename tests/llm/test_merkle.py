"""The manifest against a plain tree of levels."""

import hashlib
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import fixtures  # noqa: E402

from seedloom.llm import merkle  # noqa: E402


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        row = out[-1]
        out.append([h(*row[i : i + 2]) for i in range(0, len(row), 2)])
    return out


def siblings(rows, at):
    out = []
    for row in rows[:-1]:
        if at ^ 1 < len(row):
            out.append((row[at ^ 1], at % 2 == 1))
        else:
            out.append(None)
        at //= 2
    return out


def plain(rows, keep=lambda doc_id: doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0):
    """Rows of ``doc_id, source, lang, n_chars, text``."""

    def leaf(row):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])

    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {n: levels([x[2] for x in sorted(trees[n], key=lambda x: x[:3])]) for n in names}
    over = levels([built[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for at, (_, _, digest, r) in enumerate(sorted(trees[n], key=lambda x: x[:3])):
            path = siblings(built[n], at) + siblings(over, k)
            node = digest
            if keep(r[0]):
                node = leaf((*r[:3], None if r[3] is None else r[3] + 1, r[4]))
            for s in path:
                node = h(node) if s is None else h(s[0], node) if s[1] else h(node, s[0])
            proof = h(*[s[0] for s in path if s])
            root = over[-1][0]
            out.append((r[0], digest, built[n][-1][0], root, proof, node, node == root))
    return out


def sort(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("count", range(1, 10))
def test_addresses_are_a_layout(count):
    places = [a for row in merkle.addresses(count) for a in row]
    assert sorted(places) == list(range(2**count - 1))
    # The upper half of the levels lies in front.
    top = count // 2
    assert sorted(a for row in merkle.addresses(count)[:top] for a in row) == list(range(2**top - 1))
    assert merkle.address(count, count - 1, 0) == int(merkle.address(count, count - 1, np.zeros(1, int))[0])


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13, 16])
def test_blocks_fold_back(size):
    leaves = [h(str(n)) for n in range(size)]
    at = merkle.addresses(1 + max(0, size - 1).bit_length())
    nodes = merkle.build_block(leaves, at).decode()
    root = levels(leaves)[-1][0]
    assert nodes[:64] == root
    for n, leaf in enumerate(leaves):
        path = merkle.path_in_block(nodes, size, at, n)
        assert merkle.fold(leaf, path) == root
        assert merkle.fold(h("other"), path) != root


@pytest.mark.parametrize("height", [1, 2, 8])
@pytest.mark.parametrize("extra", [False, True])
def test_documents(spark, height, extra):
    order = ("doc_id", "source", "lang", "n_chars", "text")
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in fixtures.nasty_rows()]
    got = [tuple(r) for r in merkle.document_proofs(fixtures.nasty(spark, extra), height).collect()]
    assert order == merkle.FIELDS and sort(got) == sort(plain(rows))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("langs", [1, 3, 40])
def test_many_leaves_and_trees(spark, langs):
    rows = [(n, "s", f"l{n % langs}" if n % 3 else "l0", n, "t" * (n % 5)) for n in range(700)]
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], fixtures.DOCUMENTS)
    got = [tuple(r) for r in merkle.document_proofs(df, 3).collect()]
    assert sort(got) == sort(plain(rows))


def test_empty(spark):
    assert merkle.document_proofs(fixtures.empty(spark)).count() == 0
