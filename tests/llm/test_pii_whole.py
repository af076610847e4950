"""PII surrogates cover whole entities, however long these are."""

import random
import time
import unicodedata

import pytest

from costlight.llm import pii


def runs_in_clear(old, new):
    """Length of the longest run of characters that stay in place."""
    longest = now = 0
    for a, b in zip(old, new, strict=True):
        now = now + 1 if a == b else 0
        longest = max(longest, now)
    return longest


@pytest.mark.parametrize("n", [32, 64, 65, 128, 129, 199, 200, 201, 256, 500, 5000, 100_000])
def test_pii_long_entities_are_replaced_whole(n):
    r = random.Random(n)
    make = pii.Surrogates(b"k")
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(n))
    for kind, before, entity in (
        ("secret", "token=", letters),
        ("secret", "secret: ", ("eyJ" + letters)[:n]),
        ("token", "", hexes),
        ("token", "", hexes.upper()),
        ("email", "", letters + "@example.org"),
        ("email", "", "a.4111111111111111." + letters + "@example.org"),
    ):
        text = f"so {before}{entity} it is"
        a = text.index(entity)
        new, found = make.replace(text)
        assert [x[:3] for x in found] == [(kind, a, a + len(entity))]
        assert len(new) == len(text) and new[:a] == text[:a] and new.endswith(" it is")
        assert runs_in_clear(entity.removesuffix(".org"), new[a : a + len(entity)].removesuffix(".org")) < 12
        assert make.replace(text)[0] == new


def test_pii_long_surrogates_are_distinct():
    make = pii.Surrogates(b"k")
    r = random.Random(2)
    base = [r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(500)]
    entities = {"".join(base)}
    for k in range(500):
        other = base.copy()
        other[k] = "b" if base[k] != "b" else "c"
        entities.add("".join(other))
    assert len({make.of("secret", e) for e in entities}) == len(entities)


def test_pii_addresses_after_other_entities_and_linear_time():
    make = pii.Surrogates(b"k")
    text = "Anna Bell_smith@x.org a@b.orgx_y@c.de"
    assert [(x[0], text[x[1] : x[2]]) for x in make.replace(text)[1]] == [("name", "Anna Bell"), ("email", "_smith@x.org"), ("email", "a@b.orgx"), ("email", "_y@c.de")]
    start = time.process_time()
    for text in ("a" * 1_000_000 + " @", "4111111111111111a" * 20_000 + " @", "x@" * 200_000, "token=" + "z" * 1_000_000, "f" * 1_000_000 + "g"):
        make.replace(text)
    assert time.process_time() - start < 30


@pytest.mark.parametrize(
    "before,entity,kind",
    [
        ("Dr. ", "王小明", "name"),
        ("Frau ", "Żółć", "name"),
        ("Mr. ", "Ёъыь", "name"),
        ("Prof. ", "Ήάςώ", "name"),
        ("Dr. ", "김민준", "name"),
        ("Dr. ", "محمد", "name"),
        ("Dr. ", "さくら", "name"),
        ("Dr. ", "אברהם", "name"),
        ("", "王伟@例.org", None),
        ("", "王伟@example.org", "email"),
        ("password: ", "密码密码密码", "secret"),
        ("password: ", "!!##$$%%&&", "secret"),
        ("password: ", "密" * 700, "secret"),
        ("", "١٢٣-٤٥-٦٧٨٩", "ssn"),
    ],
)
def test_pii_of_any_script_is_replaced(before, entity, kind):
    new, found = pii.Surrogates(b"k").replace(f"so {before}{entity} ; is")
    if kind is None:  # domains that are not ASCII are not looked for (README)
        assert found == []
        return
    assert [x[0] for x in found] == [kind]
    out = found[0][3]
    assert new == f"so {before}{out} ; is" and len(out) == len(entity)
    local, own = out.split("@")[0], entity.split("@")[0]
    assert local != own and sum(a == b != "-" for a, b in zip(local, own)) <= len(own) // 2
    for a, b in zip(local, own):
        assert a.isupper() == b.isupper() and (a.isalpha(), a.isdecimal()) == (b.isalpha(), b.isdecimal())
        if a.isalpha():
            assert unicodedata.name(a).split()[0] == unicodedata.name(b).split()[0]


def test_pii_of_any_script_is_distinct():
    make = pii.Surrogates(b"k")
    for entities in ({"王" + chr(k) for k in range(0x4E00, 0x5600)}, {chr(k) for k in range(0x4E00, 0x9FFF)}, {a + b for a in "éèêàßñÿ" for b in "ÉÖéöaß"}, {a + b for a in "ёъыьщя" for b in "ёъыьщяЖ"}):
        assert len({make.of("name", e).lower() for e in entities}) == len({e.lower() for e in entities})
