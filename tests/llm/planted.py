"""Texts with planted personal data of the looser kinds, decoys beside them,
and a truth list: (texts, [(row, kind, start, end)] of what is personal)."""

import random

FILLER = ("the report was sent to all members after a long meeting about water and roads in our town because many people "
          "asked for news and nobody had written any before spring").split()


def _number(rng, n):
    return "".join(rng.choice("0123456789") for _ in range(n))


def luhn_number(rng, prefix, n):
    body = prefix + _number(rng, n - len(prefix) - 1)
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def person(rng):
    """(kind, words before, the personal text)."""
    name, host = rng.choice(["anna.berg", "j_doe", "kim42", "office", "li.wei"]), rng.choice(["mail", "example", "uni-town", "web"])
    top = rng.choice(["com", "org", "de", "fr", "es", "net"])
    kind = rng.choice(["email", "card", "phone", "ip"])
    if kind == "email":
        return kind, rng.choice(["write to", "contact", "e-mail:", "ask"]), rng.choice([
            f"{name} (at) {host} (dot) {top}", f"{name}[at]{host}[dot]{top}", f"{name} at {host} dot {top}", f"{name} (at) {host}.{top}"])
    if kind == "card":
        d, sep = luhn_number(rng, rng.choice(["4", "51", "55"]), 16), "."
        return kind, rng.choice(["card", "paid by visa", "credit card", "number"]), sep.join(d[i:i + 4] for i in range(0, 16, 4))
    if kind == "phone":
        return kind, rng.choice(["phone", "call", "tel.", "fax", "mobile", "reachable under"]), rng.choice([
            f"0049 30 {_number(rng, 3)} {_number(rng, 4)}", f"030 {_number(rng, 4)} {_number(rng, 4)}", f"(0221) {_number(rng, 3)} {_number(rng, 4)}",
            f"0033 1 {_number(rng, 2)} {_number(rng, 2)} {_number(rng, 2)} {_number(rng, 2)}"])
    return kind, rng.choice(["host", "from", "login from", "address"]), ":".join(f"{rng.randrange(65536):04x}" for _ in range(8))


def decoy(rng):
    return rng.choice([
        lambda: f"order {_number(rng, 4)} {_number(rng, 4)} {_number(rng, 4)}", lambda: f"version 0{rng.randrange(10)}.{_number(rng, 2)}.{_number(rng, 3)}",
        lambda: f"invoice {_number(rng, 4)}-{_number(rng, 4)}-{_number(rng, 4)}-{_number(rng, 4)}", lambda: f"ISBN 978-3-{_number(rng, 4)}-{_number(rng, 4)}-{_number(rng, 1)}",
        lambda: f"total {_number(rng, 3)} {_number(rng, 3)} {_number(rng, 3)}", lambda: f"page {_number(rng, 2)} {_number(rng, 3)} {_number(rng, 3)}",
        lambda: f"on 2024-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", lambda: f"ref 10{_number(rng, 1)} {_number(rng, 4)} {_number(rng, 2)}"])()


def strict(rng):
    """What the base regexes find: they teach the labelers' reliabilities."""
    return rng.choice([lambda: f"mail {rng.choice(['a.b', 'c'])}@{rng.choice(['x', 'y'])}.{rng.choice(['com', 'de'])}", lambda: f"host 10.{rng.randrange(256)}.{rng.randrange(256)}.7",
                       lambda: "card " + luhn_number(rng, "4", 16), lambda: f"call +49 30 {_number(rng, 4)} {_number(rng, 4)}"])()


def planted(rows: int, seed: int):
    rng, texts, truth = random.Random(seed), [], []
    for i in range(rows):
        text = ""
        for _ in range(rng.randrange(3, 9)):
            text += " ".join(rng.choice(FILLER) for _ in range(rng.randrange(8, 15))) + " "
            what = rng.random()
            if what < 0.4:
                kind, before, span = person(rng)
                text += before + " "
                truth.append((i, kind, len(text), len(text) + len(span)))
                text += span
            else:
                text += decoy(rng) if what < 0.75 else strict(rng)
            text += rng.choice([". ", ", ", "; "])
        texts.append(text)
    return texts, truth
