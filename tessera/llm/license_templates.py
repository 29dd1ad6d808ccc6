"""Wordings of public licences with template markup, and base phrases with their labels."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    label: str
    family: str | None
    markup: str


PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_UNDER = '<<var;name="verb";original="Licensed";match="licensed|released|distributed|available|provided|published|this work is licensed">> under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>>'
_VERSION = '<<var;name="version word";original="version";match="version|v">>'
_LATER = '<<beginOptional>>of the License<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>'
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
IN NO EVENT SHALL <<var;name="holder";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".{1,20}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY <<var;name="holder";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".{1,20}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_GNU = """is free software; you can redistribute it and/or modify it under the terms of the GNU {0} Public License as published by the Free Software Foundation<<var;name="which";original="; either";match=".{{0,1}}">> version {1}"""
_FREE = '<<var;name="program";original="This program";match="this program|this file|this library|it">> '

TEMPLATES = [
    # statements that name a licence
    Template("mit", None, f"{_UNDER} MIT License"),
    Template("mit", None, "SPDX License Identifier: MIT"),
    Template("apache-2.0", "apache", f"{_UNDER} Apache License <<beginOptional>>{_VERSION}<<endOptional>> 2.0"),
    Template("apache-2.0", "apache", "SPDX License Identifier: Apache-2.0"),
    Template("gpl-2.0", "gpl", f"{_UNDER} GNU General Public License <<beginOptional>>{_VERSION}<<endOptional>> 2 {_LATER}"),
    Template("gpl-3.0", "gpl", f"{_UNDER} GNU General Public License <<beginOptional>>{_VERSION}<<endOptional>> 3 {_LATER}"),
    Template("lgpl-2.1", "lgpl", f"{_UNDER} GNU Lesser General Public License <<beginOptional>>{_VERSION}<<endOptional>> 2.1 {_LATER}"),
    Template("lgpl-3.0", "lgpl", f"{_UNDER} GNU Lesser General Public License <<beginOptional>>{_VERSION}<<endOptional>> 3 {_LATER}"),
    Template("agpl-3.0", "agpl", f"{_UNDER} GNU Affero General Public License <<beginOptional>>{_VERSION}<<endOptional>> 3 {_LATER}"),
    Template("mpl-2.0", "mpl", f"{_UNDER} Mozilla Public License <<beginOptional>>{_VERSION}<<endOptional>> 2.0"),
    Template("bsd", None, f'{_UNDER} <<beginOptional>><<var;name="clauses";original="3";match="2|3|two|three">> clause<<endOptional>> BSD license'),
    Template("cc-by", "cc", f"{_UNDER} CC BY <<var;name=\"version\";original=\"4.0\";match=\"1 0|2 0|2 5|3 0|4 0\">>"),
    Template("cc-by-sa", "cc", f"{_UNDER} CC BY-SA <<var;name=\"version\";original=\"4.0\";match=\"1 0|2 0|2 5|3 0|4 0\">>"),
    Template("cc-by-nc", "cc", f"{_UNDER} CC BY-NC <<var;name=\"version\";original=\"4.0\";match=\"1 0|2 0|2 5|3 0|4 0\">>"),
    Template("cc-by-nc-sa", "cc", f"{_UNDER} CC BY-NC-SA <<var;name=\"version\";original=\"4.0\";match=\"1 0|2 0|2 5|3 0|4 0\">>"),
    Template("cc-by-nd", "cc", f"{_UNDER} CC BY-ND <<var;name=\"version\";original=\"4.0\";match=\"1 0|2 0|2 5|3 0|4 0\">>"),
    # whole licences and notices
    Template(
        "mit",
        None,
        f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. {_AS_IS}""",
    ),
    Template(
        "isc",
        None,
        """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="holder";original="THE AUTHOR";match=".{1,20}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    ),
    Template("bsd-2-clause", "bsd", f"{_BSD_CLAUSES} {_BSD_END}"),
    Template(
        "bsd-3-clause",
        "bsd",
        f"""{_BSD_CLAUSES} <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="organization";original="the copyright holder";match=".{{1,20}}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}""",
    ),
    Template(
        "apache-2.0",
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name="address";original="http://www.apache.org/licenses/LICENSE-2.0";match=".{1,12}">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    Template("gpl-2.0", "gpl", _FREE + _GNU.format("General", "2")),
    Template("gpl-3.0", "gpl", _FREE + _GNU.format("General", "3")),
    Template("lgpl-2.1", "lgpl", _FREE + _GNU.format("Lesser General", "2.1")),
    Template("lgpl-3.0", "lgpl", _FREE + _GNU.format("Lesser General", "3")),
    Template("agpl-3.0", "agpl", _FREE + _GNU.format("Affero General", "3")),
    Template(
        "mpl-2.0",
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<var;name=\"address\";original=\"http://mozilla.org/MPL/2.0/\";match=\".{0,12}\">>",
    ),
    Template(
        "unlicense",
        None,
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    Template(
        "zlib",
        None,
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    ),
]
