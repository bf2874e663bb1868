"""Texts of well-known short licences and one-line licence notices."""

_MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.
"""

_ZERO_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose
with or without fee is hereby granted.
"""

_ISC_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution.
"""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may
be used to endorse or promote products derived from this software without
specific prior written permission.
"""

_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN
IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no
event will the authors be held liable for any damages arising from the use of
this software.

Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that
you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.
"""

#: Licence texts and notices by identifier; a name after the colon tells variants apart.
KNOWN = {
    "MIT": _MIT,
    "MIT:untitled": _MIT.removeprefix("MIT License\n"),
    "MIT:titled": "The " + _MIT,
    "ISC": "ISC License\n\n" + _ISC_GRANT + _ISC_WARRANTY,
    "ISC:untitled": _ISC_GRANT + _ISC_WARRANTY,
    "0BSD": "BSD Zero Clause License\n\n" + _ZERO_GRANT + _ISC_WARRANTY,
    "0BSD:untitled": _ZERO_GRANT + _ISC_WARRANTY,
    "BSD-2-Clause": "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_WARRANTY,
    "BSD-2-Clause:untitled": _BSD_HEAD + _BSD_WARRANTY,
    "BSD-3-Clause": "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_WARRANTY,
    "BSD-3-Clause:untitled": _BSD_HEAD + _BSD_THIRD + _BSD_WARRANTY,
    "Zlib": "zlib License\n\n" + _ZLIB,
    "Zlib:untitled": _ZLIB,
    "MIT:notice": "Released under the MIT License.",
    "Apache-2.0:notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0:notice": "This work is licensed under the GNU General Public License, version 3.",
}

#: Notices that are looked for inside documents only.
NOTICES = {
    "CC-BY-NC-4.0:notice": "Licensed under CC BY-NC 4.0.",
}

#: Long licences that are looked for inside documents: words, run hash and digest of the canonical text.
FULL: dict[str, tuple[int, int, str]] = {
    "Apache-2.0": (1601, 0x8F337EC03E944848, "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    "GPL-2.0": (2975, 0x65081634ED25AF06, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    "GPL-3.0": (5684, 0x16C1FB7CF350266F, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    "LGPL-3.0": (1231, 0xF251E9B2984EFED8, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    "MPL-2.0": (2426, 0xA11350D9440C00F8, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
}

#: The first words of the texts of FULL.
FIRST_WORDS = {
    "Apache-2.0": "apache license version 2 0",
    "GPL-2.0": "gnu general public license version",
    "GPL-3.0": "gnu general public license version",
    "LGPL-3.0": "gnu lesser general public license",
    "MPL-2.0": "mozilla public license version 2",
}
