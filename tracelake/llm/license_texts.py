"""Known license texts and grants (fixed values)."""

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""

ZERO_BSD = ISC.replace(
    """, provided that the above
copyright notice and this permission notice appear in all copies.""",
    ".",
)

BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""

BSD_2 = f"{BSD_HEAD}\n\n{BSD_DISCLAIMER}"

BSD_3 = f"""{BSD_HEAD}

3. Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software without
specific prior written permission.

{BSD_DISCLAIMER}"""

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In
no event will the authors be held liable for any damages arising from the use
of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely,
subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim
that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute
this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this
software dedicate any and all copyright interest in the software to the public
domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""

APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not
use this file except in compliance with the License. You may obtain a copy of
the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under
the License."""

GPL_3_NOTICE = """This program is free software: you can redistribute it and/or modify it under
the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later
version.

This program is distributed in the hope that it will be useful, but WITHOUT
ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with
this program. If not, see <https://www.gnu.org/licenses/>."""

BSL_1 = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:

The copyright notices in the Software and this entire statement, including
the above license grant, this restriction and the following disclaimer,
must be included in all copies of the Software, in whole or in part, and
all derivative works of the Software, unless such copies or derivative
works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT
SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE
FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE."""

#: Full name and short names of licenses that one-line grants may name.
NAMES = {
    "MIT": ["the MIT License", "the MIT license (MIT)", "MIT"],
    "ISC": ["the ISC License", "ISC"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "BSD-3-Clause"],
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0", "Apache-2.0"],
    "GPL-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2", "GPL-2.0-only", "GPL-2.0"],
    "GPL-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3", "GPL-3.0-only", "GPL-3.0"],
    "LGPL-3.0": ["the GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "AGPL-3.0": ["the GNU Affero General Public License, version 3", "AGPL-3.0"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "CC-BY-4.0", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "CC-BY-ND-4.0"],
    "Unlicense": ["the Unlicense"],
    "Zlib": ["the zlib License", "Zlib"],
}
#: Grants on a line of their own.
GRANTS = (
    "Licensed under {}.",
    "Released under {}.",
    "Distributed under {}.",
    "This work is licensed under {}.",
    "This software is licensed under {}.",
    "This project is licensed under {}.",
    "License: {}",
    "SPDX-License-Identifier: {}",
)

KNOWN = {
    "MIT": [MIT, f"MIT License\n\n{MIT}", f"The MIT License (MIT)\n\n{MIT}"],
    "ISC": [ISC, f"ISC License\n\n{ISC}"],
    "0BSD": [ZERO_BSD],
    "BSD-2-Clause": [BSD_2, f"BSD 2-Clause License\n\n{BSD_2}"],
    "BSD-3-Clause": [BSD_3, f"BSD 3-Clause License\n\n{BSD_3}"],
    "Zlib": [ZLIB],
    "Unlicense": [UNLICENSE],
    "BSL-1.0": [BSL_1],
    "Apache-2.0": [APACHE_HEADER],
    "GPL-3.0": [GPL_3_NOTICE],
}
for _id, _names in NAMES.items():
    KNOWN.setdefault(_id, [])
    KNOWN[_id] = KNOWN[_id] + [grant.format(name) for name in _names for grant in GRANTS]

#: Long published texts: license, digest and first block of the canonical form, number of blocks (fixed values).  "Whole" is the
#: file as published, "terms" what ends with END OF TERMS AND CONDITIONS.
LONG = (
    ("Apache-2.0", "ff7be961361eda3cd2a76927dd0d9482cf45defafde2045befedf77400d98100", "apache license version 2 0 january 2004 http www apache org licenses", 34),  # whole
    ("Apache-2.0", "e9dbf930ca0f1e090ec68da9a37b657d11bc9e43b30643455d6a96dbf73116ca", "apache license version 2 0 january 2004 http www apache org licenses", 29),  # terms
    ("Artistic-1.0-Perl", "f7fec2048e2502b8b653a12ac095bcb0601f72bbd1d535b2e8adf8e097d2f915", "the artistic license", 31),  # whole
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f", "creative commons legal code", 13),  # whole
    ("GFDL-1.2", "19d29a7c800a0d85704b63b4c09d5cd01dd9a287c61e238f4717d8a9e75d214f", "gnu free documentation license version 1 2 november 2002", 58),  # whole
    ("GFDL-1.3", "e70f40f3a50995855f972521fe4eaa4af360a4597e5914977b6093cce5243480", "gnu free documentation license version 1 3 3 november 2008", 69),  # whole
    ("GPL-1.0", "9e12a40a9b22c45d116f19e1746b08ea0b853519de3e03ceb780f2a36d5f388c", "gnu general public license version 1 february 1989", 50),  # whole
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", "gnu general public license version 1 february 1989", 35),  # terms
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1", "gnu general public license version 2 june 1991", 60),  # whole
    ("GPL-2.0", "e4d14510e41435c3eb12c255b72546a3cb9943f06f209c72bc30a19095b08999", "gnu general public license version 2 june 1991", 45),  # terms
    ("GPL-3.0", "59a779feaae4de539260be3c8adb19c287a771586d211e12d93932777da37349", "gnu general public license version 3 29 june 2007", 124),  # whole
    ("GPL-3.0", "f7bb29d9a31c3a1a68ccff0d8d9053350dc0b10b52b62d46d0f2e36a41e32975", "gnu general public license version 3 29 june 2007", 111),  # terms
    ("LGPL-2.0", "96685b4d8003c3671feddcde58622afa814a3ac15dcc419f38b388aff5e16d1d", "gnu library general public license version 2 june 1991", 85),  # whole
    ("LGPL-2.0", "a07313094d4e63b099417491ebc80c933bf85c36d5afddbf13be9a11457c8513", "gnu library general public license version 2 june 1991", 73),  # terms
    ("LGPL-2.1", "22bd2802b7b313faf9750f494c8f07c9eaa0e00ba5b9f7a300e8fa36cfd1319e", "gnu lesser general public license version 2 1 february 1999", 87),  # whole
    ("LGPL-2.1", "bfe8e5dc6cef43d0c4777d9c1891f596159cda682ef40545ad2105f66b9746f1", "gnu lesser general public license version 2 1 february 1999", 75),  # terms
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", "gnu lesser general public license version 3 29 june 2007", 37),  # whole
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61", "mozilla public license version 1 1", 73),  # whole
    ("MPL-2.0", "e8c56be1c33e5804b83cd73ea30d582be9c788692b9730ab38d38b303e4f8312", "mozilla public license version 2 0", 83),  # whole
)
