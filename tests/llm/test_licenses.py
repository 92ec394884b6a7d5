from shelfmark.llm import licenses

MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\n"
       "The above copyright notice and this permission notice shall be included in all copies. The software is provided \"as is\", without warranty of any kind.")


def test_rules_in_order(spark, documents):
    docs = [(1, MIT), (2, "Licensed under the Apache License, Version 2.0. All rights reserved."), (3, "LICENSED under CC BY-NC 4.0"),
            (4, "This file is under some licence of ours."), (5, None), (6, ""), (7, "no terms here"), (7, "Released under the MIT License."), (7, "Released under the MIT License."),
            (None, "You can redistribute it and/or modify it under the terms of the GNU General Public License; either version 3 of the License, or (at your option) any later version."),
            (8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. Released under the MIT License."), (9, "x\n" * 20_000 + "All rights reserved")]
    got = {(r.doc_id, r.licenses, r.unused, r.versions) for r in licenses.scan(documents(docs)).collect()}
    assert got == {(1, "MIT", "", ""), (2, "Apache,Proprietary", "", "2.0"), (3, "CC-BY-NC", "", "4.0"), (4, "", "unknown", ""), (7, "MIT", "", ""),
                   (None, "GPL-or-later", "", "3"), (8, "MIT", "mit_grant", ""), (9, "Proprietary", "", "")}
    assert licenses.scan(documents([])).count() == 0


def test_every_rule_uses_known_sentences():
    assert {s for _, sequence in licenses.RULES for s in sequence} <= set(licenses.SENTENCES)


MIT_FULL = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_FULL = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL_FULL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
GPL2_FULL = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 2 of the License, or
 * (at your option) any later version.
"""
BSD_FULL = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY.
"""


def test_published_texts_wrapped_and_unwrapped(spark, documents):
    """MIT, the Apache and GPL notices and BSD (the end of its last sentence shortened), as they are wrapped in files and with every paragraph on one line."""
    import re
    texts = {"MIT": MIT_FULL, "Apache": APACHE_FULL, "GPL-or-later": GPL_FULL, "BSD-2-Clause": BSD_FULL + BSD_END, "BSD-3-Clause": BSD_FULL + BSD_NAMES + BSD_END}
    unwrapped = {k: re.sub(r"(?<!\n)\n(?!\n)", " ", re.sub(r"(?m)^[# ]+", "", t)) for k, t in texts.items()}
    docs = list(enumerate([*texts.values(), *unwrapped.values(), GPL2_FULL, "first line\n" + APACHE_FULL.replace("\n", "\r\n") + "def f():"]))
    got = {r.doc_id: (r.licenses, r.unused) for r in licenses.scan(documents(docs)).collect()}
    want = [*texts, *texts, "GPL-or-later", "Apache"]
    assert [got[i][0] for i in range(len(docs))] == want
    assert got[1][1] == "" and got[3][1] == "" and got[4][1] == "" and got[0][1] == "unknown"  # the copyright line


def test_long_runs_of_signs_do_not_stop_it(spark, documents):
    docs = [(1, "! " * 5_000 + "\nAll rights reserved"), (2, "licensed under" + " -" * 50_000 + "\n" * 50_000 + "the MIT license")]
    assert {r.doc_id: r.licenses for r in licenses.scan(documents(docs)).collect()} == {1: "Proprietary", 2: "MIT"}
