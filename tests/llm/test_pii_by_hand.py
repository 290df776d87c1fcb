"""Spans marked by hand, in sentences that no generator wrote: what the operator finds of them, and what it takes for one."""

from riskweave.llm import pii

#: Text, and the spans in it as kind and wording.
MARKED = [
    ("You can reach Ana at ana.silva@example.org until Friday.", [("email", "ana.silva@example.org")]),
    ("Write to tom (at) mailbox (dot) net with the signed form.", [("email", "tom (at) mailbox (dot) net")]),
    ("My address is lena [at] uni-west [dot] edu, please don't share it.", [("email", "lena [at] uni-west [dot] edu")]),
    ("contact: joe at shop dot com", [("email", "joe at shop dot com")]),
    ("For refunds mail billing_team{at}store{dot}io within a week.", [("email", "billing_team{at}store{dot}io")]),
    ("The server 10.20.30.40 stopped answering at noon.", [("ip", "10.20.30.40")]),
    ("Logins came from host 192[.]168[.]7[.]15 all night.", [("ip", "192[.]168[.]7[.]15")]),
    ("blocked ip 203(.)0(.)113(.)9 after four tries", [("ip", "203(.)0(.)113(.)9")]),
    ("Please charge 4111 1111 1111 1111, it is valid until May.", [("card", "4111 1111 1111 1111")]),
    ("card 4012-8888-8888-1881 was declined twice", [("card", "4012-8888-8888-1881")]),
    ("Her visa is 4222.2222.2222.2220 or so the note says.", [("card", "4222.2222.2222.2220")]),
    ("mastercard: 5555/5555/5555/4444", [("card", "5555/5555/5555/4444")]),
    ("Call me on +44 20 7946 0958 after six.", [("phone", "+44 20 7946 0958")]),
    ("Tel. (212) 555-0187, ask for Maria.", [("phone", "(212) 555-0187")]),
    ("my cell number: 555-013-4477", [("phone", "555-013-4477")]),
    ("Phone 030 1234 5678 is the office.", [("phone", "030 1234 5678")]),
    ("fax 0171.555.0199 or mobile 07700900461", [("phone", "0171.555.0199"), ("phone", "07700900461")]),
    ("Ring +1 (415) 555-2671 and mail to help@desk.example.com.", [("phone", "+1 (415) 555-2671"), ("email", "help@desk.example.com")]),
]
#: Texts without personal data, with what looks like it.
CLEAN = [
    "We met at noon at the dot of twelve.",
    "Version 1.2.3 follows version 1.2.2 of the library.",
    "Order 2023-0045-7781 was shipped on 12/05/2023.",
    "The ratio rose from 0.12 to 0.45 between 1990 and 2005.",
    "See page 120, section 4.5.6 for details.",
    "ISBN 978-3-16-148410-0 is out of print.",
    "He scored 21 points, 11 rebounds and 9 assists in 38 minutes.",
    "Invoice 100234 lists 12 items at 4.99 each.",
    "The chapters 1 2 3 4 were written in 1987 1988 1989 1990.",
    "Look at that dot on the map.",
    "Part no. 55-210-88 replaces 55-210-87.",
    "id 48213 and id 48214 are the same row",
]


def found(text):
    base = pii.base_spans(text)
    more = pii.selected(text, base, *model())
    return {(k, text[a:b]) for spans in (base, more) for k, some in spans.items() for a, b in some}


def model(_kept=[]):  # noqa: B006  fitted once
    if not _kept:
        _kept.append(pii.train(pii.EXAMPLES, pii.SEED))
    return _kept[0]


def test_recall_and_precision_on_spans_marked_by_hand():
    hits = wrong = 0
    missed = []
    for text, spans in [*MARKED, *((t, []) for t in CLEAN)]:
        got = found(text)
        hits += len(got & set(spans))
        missed += sorted(set(spans) - got)
        wrong += len(got - set(spans))
    total = sum(len(s) for _, s in MARKED)
    print(f"recall {hits} of {total}, wrong {wrong}, missed {missed}")
    assert hits >= 0.8 * total and hits >= 0.8 * (hits + wrong)
