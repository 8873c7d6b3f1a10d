"""Made-up sentences that hold one item each, private or only similar to private ones, to train and to judge operator 6.

No table marks personal data, so the items come from public formats. ``TRAINING``
and ``HELD_OUT`` share formats of items but no sentence form: the first fits and
calibrates the trees, the second is only there to measure precision and recall.
Everything follows from the seed.
"""

from __future__ import annotations

import random
from collections.abc import Callable

Item = Callable[[random.Random], str]

PLAIN_WORDS = (
    "after again almost along always another around because before began better between both bring came change city close cold could day different door early enough evening every far few field found friend garden "
    "aber alles als auch dann dieser doch durch einmal etwas fenster gegen haben heute immer jetzt kommen leben mehr nacht ohne schon sehen "
    "aussi avant bien chaque comme dans depuis encore entre faire grand homme jour maison moins monde nuit parler petit peu "
    "ahora algo antes aquello camino casa como cuando desde donde entonces hablar hasta mañana mejor mientras mucho noche nunca"
).split()
FIRST = "Anna Tom Maria Peter Lucía Jean Sofie Omar Ingrid Paul Clara Henrik Aisha Marco Elena Viktor".split()
LAST = "Keller Reed Okafor Lindqvist Moreau Santos Weber Novak Haddad Fischer Romero Jansen Dubois Petrov Murphy Tanaka".split()
STREETS = "Maple Oak Harbour Mill Station Church Park River Linden Victoria Garden Hill".split()
DICTIONARY = "paragraph required forgotten protected reminder important signature understanding identifier parameter happiness definition recognition patience everything argument".split()


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def drawn(r: random.Random, alphabet: str, least: int, most: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(r.randint(least, most)))


HEX = "0123456789abcdef"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIXED = UPPER + UPPER.lower() + "0123456789"


def luhn_sum(number: str) -> int:
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(v - 9 if v > 9 else v for v in doubled)


def card(r: random.Random, valid: bool = True) -> str:
    body = r.choice(["4", "51", "55", "37", "6011"])
    body += digits(r, 15 - len(body))
    last = (10 - luhn_sum(body + "0") % 10) % 10
    return body + str(last if valid else (last + r.randint(1, 9)) % 10)


def in_fours(text: str, mark: str) -> str:
    return mark.join(text[i : i + 4] for i in range(0, len(text), 4))


def phone(r: random.Random) -> str:
    a, b, c = digits(r, 3), digits(r, 3), digits(r, 4)
    return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b}-{c}", f"({a}){b}-{c}", f"{b}-{c}"])


def dashed(r: random.Random) -> str:
    return r.choice([f"{digits(r, 3)}-{digits(r, 3)}-{digits(r, 4)}", f"{digits(r, 3)}.{digits(r, 3)}.{digits(r, 4)}", f"{digits(r, 3)}-{digits(r, 4)}"])


def social(r: random.Random) -> str:
    return f"{digits(r, 3)}-{digits(r, 2)}-{digits(r, 4)}"


def iban(r: random.Random) -> str:
    text = r.choice(["DE", "FR", "ES", "NL", "GB", "IT"]) + digits(r, r.choice([18, 20, 22, 25]))
    return r.choice([text, in_fours(text, " ")])


def key_value(r: random.Random, names: str, value: str) -> str:
    mark = r.choice(['"', "'", "", ""])
    return f"{r.choice(names.split())}{r.choice(['=', ' = ', ': ', ':'])}{mark}{value}{mark}"


def password(r: random.Random) -> str:
    return r.choice([drawn(r, MIXED + "+/_-", 10, 36), drawn(r, HEX, 14, 32), r.choice(LAST) + digits(r, 4) + drawn(r, MIXED, 2, 6)])


def known_token(r: random.Random) -> str:
    return r.choice([
        f"AKIA{drawn(r, UPPER + '234567', 16, 16)}", f"ghp_{drawn(r, MIXED, 36, 36)}", f"sk-{drawn(r, MIXED, 32, 48)}", f"xoxb-{digits(r, 11)}-{drawn(r, MIXED, 24, 24)}",
        f"eyJ{drawn(r, MIXED, 18, 30)}.eyJ{drawn(r, MIXED, 30, 60)}.{drawn(r, MIXED + '_-', 30, 43)}",
    ])


def pem(r: random.Random) -> str:
    kind = r.choice(["RSA ", "EC ", ""])
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{drawn(r, MIXED + '+/', 60, 64)}\n{drawn(r, MIXED + '+/', 20, 60)}==\n-----END {kind}PRIVATE KEY-----"


def disguised(r: random.Random) -> str:
    at, dot = r.choice([" [at] ", " (at) ", "[at]", "(at)"]), r.choice([" [dot] ", ".", " (dot) ", "[dot]"])
    return f"{r.choice(FIRST).lower()}{r.choice(['', '.' + r.choice(LAST).lower(), digits(r, 2)])}{at}{r.choice(['mail', 'example', 'post', 'corp'])}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"


def street(r: random.Random) -> str:
    return f"{r.randint(1, 2400)} {r.choice(STREETS)} {r.choice(['Street', 'St.', 'Avenue', 'Road', 'Lane', 'Drive', 'Boulevard'])}"


def login(r: random.Random) -> str:
    return f"{r.choice(['https', 'ftp', 'postgres', 'redis'])}://{r.choice(FIRST).lower()}:{drawn(r, MIXED, 6, 12)}@{r.choice(['db', 'files', 'host'])}.example.org/{drawn(r, HEX, 2, 6)}"


def ipv6(r: random.Random) -> str:
    groups = [drawn(r, HEX, 1, 4) for _ in range(8)]
    return r.choice([":".join(groups), ":".join(groups[:3]) + "::" + ":".join(groups[3:5])])


def mac(r: random.Random) -> str:
    mark = r.choice(":-")
    return mark.join(drawn(r, r.choice([HEX, HEX.upper()]), 2, 2) for _ in range(6))


def date(r: random.Random) -> str:
    y, m, d = r.randint(1930, 2024), r.randint(1, 12), r.randint(1, 28)
    return r.choice([f"{d:02}.{m:02}.{y}", f"{y}-{m:02}-{d:02}", f"{m}/{d}/{y}"])


def person(r: random.Random) -> str:
    title = r.choice(["Mr. ", "Mrs. ", "Ms. ", "Dr. ", "Herr ", "Frau ", "Mme ", "Sra. "])
    return f"{title}{r.choice([r.choice(FIRST) + ' ', ''])}{r.choice(LAST)}"


def after(cues: str, item: Item) -> Item:
    """The item behind one of the cues, which a bar separates."""
    return lambda r: r.choice(cues.split("|")) + item(r)


#: (private, form) of the sentences that fit and calibrate the trees.
TRAINING: list[tuple[bool, Item]] = [
    (True, after("call |phone: |tel |reach us on |mobile ||my number: ", phone)),
    (False, after("part |order |serial |build |item no |ref ", dashed)),
    (True, after("ssn |social security number |tax id: |", social)),
    (False, after("part |order |ref |isbn |case ", social)),
    (True, after("card |visa |pay with |credit card: |", card)),
    (True, after("card |amex |charged to |", lambda r: in_fours(card(r), r.choice(" -")))),
    (False, after("order |ticket |serial |invoice |", lambda r: card(r, valid=False))),
    (False, after("version |serial |tracking |", lambda r: digits(r, r.choice([13, 14, 17, 18])))),
    (True, after("iban |account |transfer to |", iban)),
    (True, lambda r: key_value(r, "api_key secret password passwd access-key client_secret pwd apikey", password(r))),
    (False, lambda r: key_value(r, "key password secret token pwd", r.choice(DICTIONARY))),
    (True, after("use |export |header |", known_token)),
    (True, pem),
    (False, after("commit |sha1 |md5 |checksum |digest |etag ", lambda r: drawn(r, HEX, *r.choice([(32, 32), (40, 40), (64, 64)])))),
    (True, after("api key |secret |auth |signing key ", lambda r: drawn(r, HEX, *r.choice([(32, 32), (40, 40), (48, 48)])))),
    (True, after("write to |mail ||contact ", disguised)),
    (False, lambda r: f"{r.choice(['look', 'meet', 'stay', 'be'])} (at) {r.choice(['noon', 'home', 'work', 'once'])}.{r.choice(['Then', 'And', 'We', 'But'])}"),
    (True, after("lives at |ship to |address: |home: ", street)),
    (False, lambda r: f"{r.randint(2, 40)} {r.choice(['Angry', 'Little', 'Old', 'Great'])} {r.choice(['Men', 'Words', 'Years', 'Roads', 'Streets'])}"),
    (True, after("connect to |clone |", login)),
    (False, lambda r: f"{r.choice(['https', 'http'])}://www.{r.choice(['example', 'city', 'news'])}.org/{drawn(r, HEX, 2, 6)}?at={digits(r, 3)}"),
    (True, after("host |from |client |", ipv6)),
    (False, lambda r: r.choice([f"{r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}", "std::vector::iterator", f"{r.randint(1, 9)}:{r.randint(1, 9)}"])),
    (True, after("device |mac address |", mac)),
    (True, after("born on |date of birth: |dob |birthday ", date)),
    (False, after("on |published |updated |since |due |released ", date)),
    (True, after("ask |met with |signed, |", person)),
    (True, lambda r: f"my name is {r.choice(FIRST)} {r.choice(LAST)}"),
    (False, lambda r: f"{r.choice(['Mr.', 'Dr.', 'Frau'])} {r.choice(['the', 'and', 'in', 'of'])}"),
]

#: Other sentences with other values, never trained on.
HELD_OUT: list[tuple[bool, Item]] = [
    (True, lambda r: f"you can ring ({digits(r, 3)}) {digits(r, 3)}-{digits(r, 4)} until nine"),
    (True, lambda r: f"whatsapp {digits(r, 3)}-{digits(r, 3)}-{digits(r, 4)}"),
    (False, lambda r: f"model {digits(r, 3)}-{digits(r, 3)}-{digits(r, 4)} is sold out"),
    (True, lambda r: f"social security {social(r)} was leaked"),
    (True, lambda r: f"mastercard number {in_fours(card(r), ' ')}"),
    (True, lambda r: f"debit {card(r)}"),
    (False, lambda r: f"invoice {card(r, valid=False)}"),
    (True, lambda r: f"my IBAN is {iban(r)}"),
    (True, lambda r: f'token = "{drawn(r, HEX, 40, 40)}"'),
    (True, lambda r: f"secret_key: {drawn(r, MIXED, 20, 40)}"),
    (True, lambda r: f"PASSWORD={drawn(r, MIXED, 12, 20)}"),
    (False, lambda r: f"the token: {r.choice('interesting surrounding consequence remarkable'.split())} of it"),
    (False, lambda r: f"secret = {r.choice('friendship adventure discovery'.split())}"),
    (True, lambda r: f"curl -u {known_token(r)}"),
    (True, lambda r: f"the file holds {pem(r)}"),
    (False, lambda r: f"sha256 {drawn(r, HEX, 64, 64)} matches"),
    (True, lambda r: f"send it to {disguised(r)} please"),
    (True, lambda r: f"deliver to {street(r)} tomorrow"),
    (False, lambda r: f"{r.randint(100, 900)} People of Church Time"),
    (True, lambda r: f"git remote {login(r)}"),
    (True, lambda r: f"listening at {ipv6(r)}"),
    (True, lambda r: f"wifi {mac(r)}"),
    (True, lambda r: f"she was born {date(r)}"),
    (False, lambda r: f"meeting of {date(r)}"),
    (True, lambda r: f"Yours, {person(r)}"),
    (False, lambda r: f"at {r.randint(0, 23):02}:{r.randint(0, 59):02} sharp"),
]


def sentences(forms: list[tuple[bool, Item]], rows: int, seed: int) -> list[tuple[bool, str]]:
    """``rows`` sentences, each with one item of the forms in turn between plain words."""
    r, made = random.Random(seed), []
    for i in range(rows):
        private, form = forms[i % len(forms)]
        words = [" ".join(r.choice(PLAIN_WORDS) for _ in range(r.randint(1, 4))) for _ in range(2)]
        made.append((private, f"{words[0]} {form(r)}{r.choice(['', '', '.', ','])} {words[1]}"))
    return made
