"""The pseudonyms once more in plain Python, to compare every row with."""

from __future__ import annotations

import calendar
import hashlib
import re

from tablerelay.llm import pii

#: Java's class intersection, which Python doesn't have.
SHAPES = {k: v.replace("[A-Za-z0-9&&[^Tt]]", "[A-SU-Za-su-z0-9]") for k, v in pii.SHAPES.items()}
ANY = re.compile("|".join(SHAPES.values()))


def mixed(key, tweak, turn, number, size):
    return int(hashlib.sha256(f"{key}|{tweak}|{turn}|{number}".encode()).hexdigest()[:15], 16) % size


def network(left, right, left_size, right_size, key, tweak):
    for turn in range(10):
        if turn % 2 == 0:
            left = (left + mixed(key, tweak, turn, right, left_size)) % left_size
        else:
            right = (right + mixed(key, tweak, turn, left, right_size)) % right_size
    return left, right


def digits_of(text, key, kind):
    n, head = len(text), len(text) // 2
    left, right = network(int(text[:head]), int(text[head:]), 10**head, 10 ** (n - head), key, f"{kind}{n}")
    return f"{left:0{head}}{right:0{n - head}}"


def refill(shape, signs, places="0123456789"):
    left = iter(signs)
    return "".join(next(left) if c in places else c for c in shape)


def checks(text):
    return sum(d - 9 if d > 9 else d for d in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(text)))) % 10


def card(text, key):
    plain = re.sub("[^0-9]", "", text)
    body = digits_of(plain[:-1], key, "card")
    return refill(text, body + str((10 - checks(body + "0")) % 10))


def cards(value, key):
    groups, parts = re.split("[ -]", value), re.findall("[0-9]+[ -]?", value)
    usual, other = [], []
    for i in range(len(groups)):
        ends = [j for j in range(i, len(groups)) if 13 <= len("".join(groups[i:j + 1])) <= 19 and checks("".join(groups[i:j + 1])) == 0]
        named = [j for j in ends if "-".join(str(len(g)) for g in groups[i:j + 1]) in pii.CARD_GROUPS]
        usual.append(named[0] if named else None)
        other.append(max(ends) if ends else None)
    at, text, n = 0, "", 0
    while at < len(groups):
        end = usual[at]
        if end is None and other[at] is not None and all(u is None for u in usual[at:other[at] + 1]):
            end = other[at]
        if end is None:
            text, at = text + parts[at], at + 1
        else:
            text, at, n = text + card("".join(parts[at:end + 1]), key), end + 1, n + 1
    return (text, n) if n else None


def phone(value, key):
    plain = re.sub("[^0-9]", "", value)
    n = len(plain) - 3 if value.startswith("+") and len(plain) <= 10 else 10
    kept, last = plain[:-n], plain[-n:]
    if n != 10:
        return refill(value, kept + digits_of(last, key, "phone"))
    area, exchange, serial = int(last[:3]), int(last[3:6]), int(last[6:])
    numbered, size = area >= 200 and exchange >= 200, 80_000 if area >= 200 and exchange >= 200 else 60_000
    if numbered:
        index = ((area - 200) * 800 + exchange - 200) * 10_000 + serial
    else:
        index = int(last) if area < 200 else 2_000_000_000 + (area - 200) * 2_000_000 + exchange * 10_000 + serial
    left, right = network(index // size, index % size, size, size, key, f"phone{size}")
    at = left * size + right
    if numbered:
        new = (at // 8_000_000 + 200) * 10_000_000 + (at // 10_000 % 800 + 200) * 10_000 + at % 10_000
    else:
        new = at if at < 2_000_000_000 else ((at - 2_000_000_000) // 2_000_000 + 200) * 10_000_000 + (at - 2_000_000_000) % 2_000_000
    return refill(value, f"{kept}{new:010}")


def ssn(value, key):
    area, group, serial = (int(x) for x in value.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    place = (area - 2 if area > 666 else area - 1) * 99 + group - 1
    left, right = network(place, serial - 1, 898 * 99, 9999, key, "ssn")
    three = left // 99
    return f"{three + 2 if three >= 665 else three + 1:03}-{left % 99 + 1:02}-{right + 1:04}"


def ip(value, key):
    a, b, c, d = (int(x) for x in value.split("."))
    if max(a, b, c, d) > 255:
        return None
    left, right = network(a * 256 + b, c * 256 + d, 65536, 65536, key, "ip")
    return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"


def date(value, key):
    part = re.split("[-./]", value)
    year_first = len(part[0]) == 4
    day_first = not year_first and ("." in value or (int(part[0]) > 12 and int(part[1]) <= 12))
    y, m, d = (0, 1, 2) if year_first else (2, 1, 0) if day_first else (2, 0, 1)
    year, month, day = int(part[y]), int(part[m]), int(part[d])
    if not 1900 <= year <= 2099 or not 1 <= month <= 12 or not 1 <= day <= calendar.monthrange(year, month)[1]:
        return None
    if (month, day) == (2, 29):
        at = (year - 1900) // 4 - 1
        left, right = network(at // 7, at % 7, 7, 7, key, "date0")
        year = 1900 + (left * 7 + right + 1) * 4
    else:
        months = range(1, 10) if month <= 9 else range(10, 13)
        days = range(1, 10) if day <= 9 else range(10, 13) if day <= 12 else range(13, 32)
        same = [(a, b) for a in months for b in days if b <= calendar.monthrange(2001, a)[1]]
        kind = (1 if month <= 9 else 4) + (0 if day <= 9 else 1 if day <= 12 else 2)
        left, right = network(same.index((month, day)), year - 1900, len(same), 200, key, f"date{kind}")
        (month, day), year = same[left], 1900 + right
    new = {y: str(year), m: str(month).zfill(len(part[m])), d: str(day).zfill(len(part[d]))}
    return refill(value, "".join(new[k] for k in range(3)))


def spell(number, width):
    out = ""
    while number:
        number, k = divmod(number, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[k] + out
    return out.rjust(width, "0") if width else ""


def email(value, key):
    local, domain = value.split("@")
    local, new = local.lower(), ""
    signs = re.sub("[^0-9a-z]", "", local)
    for place in range((len(signs) + 9) // 10):
        word = signs[place * 10:place * 10 + 10]
        n, head = len(word), len(word) // 2
        left, right = network(int(word[:head] or "0", 36), int(word[head:], 36), 36**head, 36 ** (n - head), key, f"email-{n}-{place}")
        new += spell(left, head) + spell(right, n - head)
    return f"{refill(local, new, '0123456789abcdefghijklmnopqrstuvwxyz')}@{domain}"


MAKE = {"email": email, "ip": ip, "date": date, "phone": phone, "ssn": ssn, "card": cards}


def pseudonymised(text, key):
    """The text with pseudonyms, and how many of each kind."""
    counts, out, at = dict.fromkeys(MAKE, 0), "", 0
    for found in ANY.finditer(text or ""):
        value = new = found.group()
        for kind, make in MAKE.items():
            if re.fullmatch(SHAPES[kind], value) and (made := make(value, key)) is not None:
                new, n = made if kind == "card" else (made, 1)
                counts[kind] += n
                break
        out, at = out + text[at:found.start()] + new, found.end()
    return None if text is None else out + text[at:], counts
