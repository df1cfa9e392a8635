"""Licence templates: fixed values.

``PHRASES`` are recognised whole; ``TEMPLATES`` are the openings, grants and notices that files carry;
``NEEDS`` are the words by which licences of like wording differ.
"""

PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for
the specific language governing permissions and limitations under the License."""),
    ("bsd-2", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""),
    ("bsd-3", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written
permission."""),
    ("bsd-3", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version."""),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation"""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
(at your option) any later version."""),
    ("lgpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version."""),
    ("agpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("gpl-3", """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not
allowed."""),
    ("gpl-2", """GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not
allowed."""),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License version 2 as published by the Free Software Foundation."""),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License version 3 as published by the Free Software Foundation."""),
    ("lgpl", """GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation,
Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not
allowed."""),
    ("lgpl", """GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software
Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing
it is not allowed."""),
    ("agpl-3", """GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software
Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing
it is not allowed."""),
    ("apache-2", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE,
REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction,
and distribution as defined by Sections 1 through 9 of this document."""),
    ("mpl-1.1", """The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you
may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an "AS IS" basis, WITHOUT
WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and
limitations under the License."""),
    ("0bsd", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("bsl-1", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so, all subject to the following:"""),
    ("bsl-1", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or
copy at http://www.boost.org/LICENSE_1_0.txt)"""),
    ("epl-2", """This program and the accompanying materials are made available under the terms of the Eclipse Public
License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("epl-1", """All rights reserved. This program and the accompanying materials are made available under the terms of
the Eclipse Public License v1.0 which accompanies this distribution, and is available at
http://www.eclipse.org/legal/epl-v10.html"""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this
software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to
the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source
distribution."""),
    ("artistic-2", """This program is free software; you can redistribute it and/or modify it under the terms of the
Artistic License version 2.0."""),
    ("wtfpl", """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and
changing it is allowed as long as the name is changed."""),
    ("cc0", """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring
rights to this software to the public domain worldwide. This software is distributed without any warranty."""),
    ("cc0", """To the extent possible under law, the person who associated CC0 with this work has waived all copyright
and related or neighboring rights to this work."""),
    ("cc-by", """This work is licensed under a Creative Commons Attribution 4.0 International License."""),
    ("cc-by-sa", """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."""),
    ("cc-by-nd", """This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."""),
    ("cc-by-nc", """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."""),
    ("cc-by-nc-sa", """This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0
International License."""),
    ("cc-by-nc-nd", """This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0
International License."""),
)

_AFTER_KIND = ("1 0", "2 0", "2 5", "3 0", "4 0", "international", "unported", "license")

# Words that tell a licence from those that share its wording: of each group one must stand in the span.
NEEDS = {
    "mit": (("person obtaining a copy of this software",),),
    "apache-2": (("apache license",),),
    "bsd-2": (("redistributions in binary form",),),
    "bsd-3": (("endorse or promote products",),),
    "isc": (("provided that the above copyright notice",),),
    "0bsd": (("hereby granted the software is provided",),),
    "gpl-3": (("gnu general public license",), ("version 3", "gplv3")),
    "gpl-2": (("gnu general public license",), ("version 2", "gplv2")),
    "lgpl": (("lesser general public license", "library general public license"),),
    "agpl-3": (("affero general public license",),),
    "mpl-2": (("mozilla public license",), ("v 2", "version 2", "license 2")),
    "mpl-1.1": (("mozilla public license version 1",),),
    "unlicense": (("unencumbered software",),),
    "bsl-1": (("person or organization obtaining", "boost software license"),),
    "epl-2": (("eclipse public license 2", "eclipse public license v 2", "eclipse public license v2", "eclipse public license version 2"),),
    "epl-1": (("eclipse public license 1", "eclipse public license v 1", "eclipse public license v1", "eclipse public license version 1"),),
    "zlib": (("origin of this software must not be misrepresented",),),
    "artistic-2": (("artistic license",),),
    "wtfpl": (("modified copies of this license document",),),
    "cc0": (("neighboring rights",),),
    "cc-by": (tuple(f"attribution {after}" for after in _AFTER_KIND),),
    "cc-by-sa": (("attribution sharealike", "attribution share alike"),),
    "cc-by-nd": (("attribution noderivatives", "attribution noderivs", "attribution no derivatives"),),
    "cc-by-nc": (tuple(f"{kind} {after}" for kind in ("noncommercial", "non commercial") for after in _AFTER_KIND),),
    "cc-by-nc-sa": (("noncommercial sharealike", "non commercial sharealike", "noncommercial share alike"),),
    "cc-by-nc-nd": (("noncommercial noderivatives", "noncommercial noderivs", "non commercial noderivatives"),),
}
