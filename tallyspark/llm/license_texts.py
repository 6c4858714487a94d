"""Public licenses and the notices that name them, as templates for the license scan.

Versions are templates of their own. Texts of fewer than five words are no templates (``SPDX-License-Identifier: MIT`` has four).
"""

#: Names and texts of public licenses and of the notices that name them.
TEMPLATES = (
    ("MIT notice", "Released under the MIT License."),
    ("Apache-2.0 notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0 notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0 notice", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1 notice", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0 notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0 notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0 short notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0 short notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0 short notice", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-4.0 notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0 notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0 notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ND-4.0 notice", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0 long notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0 notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0 notice", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-3.0 notice", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-SA-3.0 notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("CC0-1.0 notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MPL-1.1 notice", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this "
     "file except in compliance with the License."),
    ("MPL-2.0 notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-1.0 notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 "
     "which accompanies this distribution, and is available at"),
    ("EPL-2.0 notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
     "which is available at"),
    ("CDDL notice", "The contents of this file are subject to the terms of the Common Development and Distribution License."),
    ("BSL-1.0 notice", "Distributed under the Boost Software License, Version 1.0."),
    ("OFL-1.1 notice", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("Apache-2.0 identifier", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause identifier", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause identifier", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0 identifier", "SPDX-License-Identifier: MPL-2.0"),
    ("GPL-2.0-only identifier", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0-or-later identifier", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0-only identifier", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later identifier", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1-or-later identifier", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("AGPL-3.0-only identifier", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT disclaimer", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
     "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
     "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC disclaimer", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
     "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met:"),
    ("BSD third clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission."),
    ("BSD disclaimer", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
     "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
     "DISCLAIMED."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
     "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) "
     "any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
     "any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
     "any later version."),
    ("GNU license text", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not "
     "allowed."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
     "non-commercial, and by any means."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
     "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and "
     "transmit the Software, and to prepare derivative works of the Software"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
     "for any damages arising from the use of this software."),
)
