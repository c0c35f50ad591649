import random
import re

import pytest

from corpuslens.llm import license_scan as L

GRANT = '''Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so'''
NOTICE = '''subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.'''
AS_IS = '''THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.'''
ADVERTISING = '''Except as contained in this notice, the name of Ada Example shall not be used
in advertising or otherwise to promote the sale, use or other dealings in this
Software without prior written authorization from Ada Example.'''
FORMS = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:'''
CLAUSES = [
    '''Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.''',
    '''Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.''',
    '''All advertising materials mentioning features or use of this software must
display the following acknowledgement: This product includes software developed
by the Example Society.''',
    '''Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.''',
]
DAMAGES = '''THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'''
USE = '''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted'''
COPIES = "provided that the above copyright notice and this permission notice appear in all copies."
DISCLAIMED = '''THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.'''
APACHE = '''Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.'''


def gnu(name, version):
    return f'''This program is free software: you can redistribute it and/or modify it under
the terms of the GNU {name} as published by the Free Software Foundation,
either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {name} for more details.'''


def bsd(*clauses, mark="{}. "):
    return "\n".join([FORMS, *(mark.format(i) + CLAUSES[c] for i, c in enumerate(clauses, 1)), DAMAGES])


TEXTS = {
    "mit-text": f"{GRANT}, {NOTICE}\n\n{AS_IS}",
    "mit-0-text": f"{GRANT}.\n\n{AS_IS}",
    "x11-text": f"{GRANT}, {NOTICE}\n\n{AS_IS}\n\n{ADVERTISING}",
    "isc-text": f"{USE}, {COPIES}\n\n{DISCLAIMED}",
    "0bsd-text": f"{USE}.\n\n{DISCLAIMED}",
    "bsd-2-text": bsd(0, 1),
    "bsd-3-text": bsd(0, 1, 3),
    "bsd-4-text": bsd(0, 1, 2, 3),
    "apache-2.0-text-notice": APACHE,
    "gpl-2.0-text-notice": gnu("General Public License", 2),
    "gpl-3.0-text-notice": gnu("General Public License", 3),
    "lgpl-2.1-text-notice": gnu("Lesser General Public License", "2.1"),
    "lgpl-3.0-text-notice": gnu("Lesser General Public License", 3),
    "agpl-3.0-text-notice": gnu("Affero General Public License", 3),
    "gpl-3.0-heading": "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007",
    "lgpl-2.1-heading": "GNU LESSER GENERAL PUBLIC LICENSE\n  Version 2.1, February 1999",
}
BASE = {"mit", "apache", "gpl"}


def labels(scanner, text):
    return set(filter(None, scanner.scan(text)[5].split(","))) - BASE


@pytest.mark.parametrize("label", list(TEXTS))
def test_whole_licences_tell_their_variants_apart(label):
    scanner = L.LicenseScanner()
    assert labels(scanner, TEXTS[label]) == {label}
    assert labels(scanner, f"Some words before.\n{TEXTS[label]}\nand after") == {label}
    n, *_, score = scanner.scan(TEXTS[label])
    assert score > 0.9, n


@pytest.mark.parametrize("label", ["mit-text", "mit-0-text", "x11-text", "isc-text", "bsd-2-text", "bsd-3-text", "bsd-4-text", "apache-2.0-text-notice", "gpl-3.0-text-notice"])
def test_an_edited_mandatory_word_is_refused(label):
    """Each word of the text is replaced, left out or doubled in turn; only replaceable and optional regions bear it."""
    scanner, words = L.LicenseScanner(), [w.decode() for w in L.words_of(TEXTS[label])]
    template = dict(L.TEMPLATES)[label]
    free = sum(int(n) for n in re.findall(r"\{\{(\d+)\}\}", template)) + sum(len(m.split()) for m in re.findall(r"\[\[.*?\]\]", template))
    borne = 0
    for i in range(0, len(words), 3):
        edited = " ".join([*words[:i], "zzz", *words[i + 1 :]])
        borne += label in labels(scanner, edited)
    assert borne <= free and borne < len(words) / 3 / 3
    for word in ("liable", "provided", "express") if "is" in words else ():
        if word in words:
            assert label not in labels(scanner, " ".join(w for w in words if w != word))


def test_an_opening_is_not_the_licence():
    scanner = L.LicenseScanner()
    assert labels(scanner, GRANT) == {"mit-opening"}
    assert labels(scanner, f"{FORMS} {CLAUSES[0]}") == {"bsd-opening"}
    assert labels(scanner, bsd(0, 1, mark="")) == {"bsd-2-text"} and labels(scanner, bsd(0, 1, mark="* ")) == {"bsd-2-text"}
    assert labels(scanner, bsd(0, 1, 3).replace('"AS IS"', "“AS IS”").replace("'", "’")) == {"bsd-3-text"}
    # A licence and, elsewhere, an opening alone: both.
    assert labels(scanner, f"{TEXTS['mit-text']} and then {GRANT} for ever") == {"mit-text", "mit-opening"}


def test_score_is_the_share_of_covered_words():
    scanner = L.LicenseScanner([("a", "one two three"), ("b", "two three four")])
    assert scanner.scan("one two three four x x x x")[5:] == ("a,b", 0.5)
    assert scanner.scan("mit license x x")[6] == 0.5
    assert scanner.scan("x")[6] == 0.0 and scanner.scan(None)[6] == 0.0


@pytest.mark.parametrize("remembered", [3, 20_000])
def test_the_combined_automaton_finds_what_each_template_finds(monkeypatch, remembered):
    monkeypatch.setattr(L, "STATES", remembered)
    rng = random.Random(remembered)
    templates = [("t0", "a [[b c]] d"), ("t1", "a {{3}} a"), ("t2", "b [[{{2}}]] b c"), ("t3", "c d"), ("t4", "d [[a]] [[b]] c")]
    single = [L.compile_template(*t) for t in templates]
    scanner = L.LicenseScanner(templates)
    hits = 0
    for _ in range(3000):
        words = [rng.choice([b"a", b"b", b"c", b"d", b"x", b"y"]) for _ in range(rng.randrange(12))]
        want = {k for k, a in enumerate(single) if any(a.match_at(words, i) is not None for i in range(len(words)))}
        assert scanner.combined.found(words) == want
        hits += len(want)
    assert hits > 500
