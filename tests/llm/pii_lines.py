"""Lines labelled by hand: what is personal data beyond the base rules, and what only looks like it."""

#: (line, the personal data in it that no base rule finds).
LINES = [
    ("write to jane (at) mail3.example.com today", ["jane (at) mail3.example.com"]),
    ("reach anna.schmidt [at] posteo [dot] de for details", ["anna.schmidt [at] posteo [dot] de"]),
    ("contact bob at company dot com before noon", ["bob at company dot com"]),
    ("Kontakt: info(at)firma.de", ["info(at)firma.de"]),
    ("mail max.mueller @ web.de if it fails", ["max.mueller @ web.de"]),
    ("questions go to me[at]site.org, thanks", ["me[at]site.org"]),
    ("her address is lucy at lakehouse dot net", ["lucy at lakehouse dot net"]),
    ("ask sales (at) shop (dot) example (dot) com", ["sales (at) shop (dot) example (dot) com"]),
    ("please call 555-123-4567 after six", ["555-123-4567"]),
    ("phone: 202 555 0143", ["202 555 0143"]),
    ("Tel. 0171 2345678", ["0171 2345678"]),
    ("my mobile is 555.867.5309", ["555.867.5309"]),
    ("fax 030-9876543", ["030-9876543"]),
    ("ring (212) 555-0187 and ask for Sam", ["(212) 555-0187"]),
    ("tel 01 44 55 66 77", ["01 44 55 66 77"]),
    ("paid with card 4111  1111  1111  1111 yesterday", ["4111  1111  1111  1111"]),
    ("visa 4111.1111.1111.1111 was charged", ["4111.1111.1111.1111"]),
    ("the old card 4222222222222 is void", ["4222222222222"]),
    ("amex 3782 822463 10005 on file", ["3782 822463 10005"]),
    ('api_key = "sk9f8a7b6c5d4e3f2a1b0c9d8e"', ["sk9f8a7b6c5d4e3f2a1b0c9d8e"]),
    ("password: hunter2hunter2xyz", ["hunter2hunter2xyz"]),
    ("token=ghp16C7e42F292c6912E7710c838347Ae178B4a", ["ghp16C7e42F292c6912E7710c838347Ae178B4a"]),
    ("SECRET: 9d8f7e6a5b4c3d2e1f00aabbccddeeff", ["9d8f7e6a5b4c3d2e1f00aabbccddeeff"]),
    ("we met at home and talked", []),
    ("look at the river. Then turn left", []),
    ("she arrived at noon with two friends", []),
    ("he laughed at it.", []),
    ("order 1234567890 was shipped", []),
    ("page 10293847561 does not exist", []),
    ("ISBN 978-3-16-148410-0", []),
    ("the table has 1 234 567 rows", []),
    ("from 10:30 to 12:45 on 2024-01-15", []),
    ("pages 100-200 and 300-400", []),
    ("version 1.2.3 replaces 1.2.2", []),
    ("serial 4111 1111 1111 1112", []),
    ("key: understanding-of-the-matter", []),
    ("password: forgotten-by-everyone", []),
    ("the secret = unbelievable", []),
    ("1999-2004 were good years, 2005-2009 were not", []),
    ("results 12.5 13.7 14.9 15.2", []),
    ("the score was 3-2 and then 4-2", []),
    ("total 12,345.67 of 98,765.43", []),
    ("chapter 300.400.500.600 of the list", []),
    ("it costs 20 at 5 per piece", []),
    ("born 12.04.1987, moved 01.05.2001", []),
]
