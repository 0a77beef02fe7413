"""The catalogue: letters, variants, categories, particles, written units and the reverse table, as small tables.

Rows are stated as text and parsed once for each process. `checks` returns what a data-quality job would report.
"""

from __future__ import annotations

from functools import cache

LOCALE = "MNG"
CANONICAL_VERSION = "mng-canonical/5"
VERSION = "0.2.0"
POSITIONS = ("isol", "init", "medi", "fina")
FVS = {1: "\u180b", 2: "\u180c", 3: "\u180d", 4: "\u180f"}
FVS_NUMBER = {c: n for n, c in FVS.items()}
MVS, NNBSP, NIRUGU, ZWJ, ZWNJ = "\u180e", "\u202f", "\u180a", "\u200d", "\u200c"
STRUCTURAL = {"Mvs": MVS, "Nirugu": NIRUGU, "Zwj": ZWJ, "Zwnj": ZWNJ}
#: What a word consists of, as a character class for Java and Python alike.
WORD_CLASS = "\u180a-\u180f\u181a-\u18af\u200c\u200d\u202f"
LETTER_CLASS = "\u181a-\u18af"
MAX_RECORDS = 1024

# Fixed values. One letter a line: code point, alias, then its variants at isol, init, medi and fina. A variant is
# fvs=units/conditions; no number means without FVS, a star marks the position's default.
LETTERS = """
1820 a  | 1=A 2=Aa/chachlag/particle 3*=A+A | 1=A/particle 2*=A+A | *=A 1=A+A | 1=Aa/post_bowed 2*=A
1821 e  | 1=Aa/chachlag/particle 2*=A | *=A 1=A+A | *=A | 1=Aa/post_bowed 2*=A
1822 i  | 1=I/particle 2=Ix 3*=A+I | 1=I/particle 2*=A+I | 1=A+I 2=I+I/vowel_devsger 3*=I | *=I
1823 o  | *=A+O | *=A+O | *=O 1=A+O | 1=O/marked/post_bowed 2*=U
1824 u  | 1=U/particle 2=Ux 3*=A+O | 1=O/particle 2*=A+O | *=O 1=A+O | 1=O/marked/post_bowed 2*=U/particle
1825 oe | *=A+Ue 1=A+U | *=A+O+I | 1=O+I/marked 2=A+O+I 3*=O | 1=Ue/marked 2=O/post_bowed 3*=U
1826 ue | *=A+Ue 1=A+U 2=U/particle 3=Ux | 1=O/particle 2*=A+O+I | 1=O+I/marked 2=A+O+I 3*=O/particle | 1=Ue/marked 2=O/post_bowed 3*=U/particle
1827 ee | *=A+W | *=A+W | *=W | *=W
1828 n  | *=N 1=A | *=N 1=A | 1=N/onset 2*=A/devsger | 1=N/chachlag_onset 2*=A/devsger
1829 ng | *=A+G | *=A+G | *=A+G | *=A+G
182A b  | *=B | *=B | *=B | *=B 1=B2
182B p  | *=P | *=P | *=P | *=P
182C h  | *=H 1=Hx 2=G 4=Gx | 1=Hx 2=G/feminine 3*=H/masculine_onset 4=Gx | 1=Hx 2*=G/feminine 3=H/masculine_onset/masculine_devsger 4=Gx | *=H/chachlag_onset/masculine_devsger 1=Hx
182D g  | *=Hx 1=H 2=G 4=Gx | 1=H 2=G/feminine 3*=Hx/masculine_onset 4=Gx | 1=Hx/masculine_onset 2*=G/feminine 3=H/masculine_devsger/dotless 4=Gx | 1=H/chachlag_onset_gb/masculine_devsger/dotless 2*=G/feminine 3=Hx/chachlag_onset
182E m  | *=M | *=M | *=M | *=M
182F l  | *=L | *=L | *=L | *=L
1830 s  | *=S | *=S | *=S | *=S 1=Sz
1831 sh | *=Sh 1=S | 1=S/dotless 2*=Sh | 1=S/dotless 2*=Sh | *=Sh
1832 t  | *=T | *=T | 1=T/devsger 2*=D | *=T
1833 d  | *=D 1=T | 1=D/marked/particle 2*=T/onset | 1=D/onset 2*=Dd/devsger | *=Dd/devsger 1=D
1834 ch | *=Ch | *=Ch | *=Ch | *=Ch
1835 j  | *=I 1=I/chachlag_onset | *=I | *=J | *=J 1=I/chachlag_onset
1836 y  | *=Y 1=I | 1=I/particle 2*=Y | 1=I/particle 2=I+I 3*=Y | *=I
1837 r  | *=R | *=R | *=R | *=R
1838 w  | *=W | *=W | *=W 1=O | *=W 1=U/chachlag_onset
1839 f  | *=F | *=F | *=F | *=F
183A k2 | *=K2 | *=K2 | *=K2 | *=K2
183B k  | *=K | *=K | *=K | *=K
183C c  | *=C | *=C | *=C | *=C
183D z  | *=Z | *=Z | *=Z | *=Z
183E hh | *=A+Hr | *=A+Hr | *=Hr | *=Hr
183F rh | *=Rh | *=Rh | *=Rh | *=Rh
1840 lh | *=L+Hr | *=L+Hr | *=L+Hr | *=L+Hr
1841 zr | *=Zr | *=Zr | *=Zr | *=Zr
1842 cr | *=Cr | *=Cr | *=Cr | *=Cr
"""
# Gender of the vowels; all other letters are consonants.
MASCULINE, FEMININE, NEUTER = ("a", "o", "u"), ("e", "ee", "oe", "ue"), ("i",)
# Particles as letters, and which of them (from 0, the MVS counted) take their particle form.
PARTICLES = """
u u:0; ue ue:0; b ue ue:1; mvs a ch a:1; mvs a ch a g a n:1; mvs i:1; mvs i y a r:1,2; mvs i y e r:1,2;
mvs i y a n:1,2; mvs i y e n:1,2; mvs u:1; mvs ue:1; mvs u n:1; mvs ue n:1; mvs u d:1; mvs ue d:1; mvs ch u:2;
mvs ch ue:2; mvs t u:2; mvs t ue:2; mvs t ue r:2; mvs t ue n i:2; mvs y ue g e n:2; mvs l ue g e:2;
mvs n ue g ue d:2; mvs n ue g e n:2; mvs y ue m:2; mvs y ue m s e n:2; mvs h ue:2; mvs y i:1; mvs y i n:1;
mvs d a g a n:1; mvs d e g e n:1; mvs d u:1,2; mvs d ue:1,2; mvs d a g:1; mvs d e g:1; mvs d a h i:1; mvs d e h i:1;
mvs d u r:1; mvs d ue r:1,2; mvs d u n i:1; mvs d ue n i:1,2; mvs d u g a r:1; mvs d ue g e r:1,2; mvs d a:1; mvs d e:1
"""
# The letter and FVS that stand for written units at a position.
REVERSE = {
    "isol": "A=a1 A+A=a3 A+G=ng A+Hr=hh A+I=i3 A+O=o A+U=oe1 A+Ue=oe A+W=ee Aa=a2 B=b C=c Ch=ch Cr=cr D=d F=f G=g2 Gx=h4 H=h Hx=h1 I=i1 Ix=i2 K=k K2=k2 L=l L+Hr=lh M=m N=n P=p R=r Rh=rh S=s Sh=sh T=t U=u1 Ux=u2 W=w Y=y Z=z Zr=zr",
    "init": "A=a1 A+A=a2 A+G=ng A+Hr=hh A+I=i2 A+O=o A+O+I=oe A+W=ee B=b C=c Ch=ch Cr=cr D=d1 F=f G=g2 Gx=h4 H=h3 Hx=h1 I=i1 K=k K2=k2 L=l L+Hr=lh M=m N=n O=u1 P=p R=r Rh=rh S=s Sh=sh2 T=t W=w Y=y2 Z=z Zr=zr",
    "medi": "A=a A+A=a1 A+G=ng A+I=i1 A+O=o1 A+O+I=oe2 B=b C=c Ch=ch Cr=cr D=t2 Dd=d2 F=f G=g2 Gx=h4 H=h3 Hr=hh Hx=h1 I=i3 I+I=i2 J=j K=k K2=k2 L=l L+Hr=lh M=m N=n1 O=o O+I=oe1 P=p R=r Rh=rh S=s Sh=sh2 T=t1 W=w Y=y3 Z=z Zr=zr",
    "fina": "A=a2 A+G=ng Aa=a1 B=b B2=b1 C=c Ch=ch Cr=cr D=d1 Dd=d F=f G=g2 H=h Hr=hh Hx=h1 I=i J=j K=k K2=k2 L=l L+Hr=lh M=m N=n1 O=o1 P=p R=r Rh=rh S=s Sh=sh Sz=s1 T=t U=o2 Ue=oe1 W=w Z=z Zr=zr",
}
# After an initial or medial G or Gx, these units are written with feminine vowels.
REVERSE_FEMININE = {"isol": "A=e2 Aa=e1 U=ue2 Ux=ue3", "init": "A=e O=ue1", "medi": "A=e O=oe3 W=ee", "fina": "A=e2 Aa=e1 O=oe2 U=oe3 Ue=oe1 W=ee"}
# Units and the positions in which they can be asked for.
POSITIONED = {
    "isol": "A Aa I Ix U Ux",
    "init": "A B C Ch Cr D F G Gx H Hx I K K2 L M N O P R Rh S Sh T W Y Z Zr",
    "medi": "A B C Ch D Dd F G Gx H Hr Hx I J K K2 L M N O P R Rh S Sh T W Y Z",
    "fina": "A Aa B B2 C Ch D Dd F G H Hr Hx I J K K2 L M N O P R Rh S Sh Sz T U Ue W Z",
}
# Units that look alike in two positions.
SAME_INIT_MEDI = "B C Ch D F G Gx I K K2 O P R Rh S Sh T W Y Z Zr"
SAME_FINA_MEDI = "O Zr"
SAME_ISOL_FINA = "Aa I U Zr"
SAME_ISOL_INIT = "B C Ch D F G Gx H Hx K K2 L M N P R Rh S Sh T W Y Z Zr"
#: Units with a bow on the right.
BOWED = frozenset("B P F G Gx K K2".split())
RULES = (
    "III.1.chachlag", "III.2a.o_u_oe_ue.marked", "III.2a.o_u_oe_ue.marked.GB.A", "III.2a.o_u_oe_ue.marked.GB.B", "III.2a.oe_ue.cluster.marked",
    "III.2a.d.marked", "III.2c.chachlag_onset", "III.2e.n_t_d.onset_devsger", "III.2f.h_g.harmony", "III.2g.t.devsger", "III.2g.sh.dotless",
    "III.2g.g.dotless", "III.3.particle", "III.4.vowel_devsger", "III.5.post_bowed",
)


class Catalogue:
    """The tables as dictionaries."""

    def __init__(self) -> None:
        self.alias: dict[str, str] = {}
        self.char: dict[str, str] = {}
        #: (alias, position, fvs or 0) -> units
        self.variant: dict[tuple[str, str, int], tuple[str, ...]] = {}
        self.default: dict[tuple[str, str], tuple[str, ...]] = {}
        #: (alias, position, condition) -> units; the first variant that carries the condition
        self.conditional: dict[tuple[str, str, str], tuple[str, ...]] = {}
        #: (alias, position, fvs, units, default, conditions)
        self.rows: list[tuple[str, str, int, tuple[str, ...], bool, tuple[str, ...]]] = []
        for line in LETTERS.strip().splitlines():
            head, *cells = line.split("|")
            code, alias = head.split()
            self.alias[chr(int(code, 16))] = alias
            self.char[alias] = chr(int(code, 16))
            for position, cell in zip(POSITIONS, cells, strict=True):
                for text in cell.split():
                    key, value = text.split("=")
                    units, *conditions = value.split("/")
                    number, form = int(key.rstrip("*") or 0), tuple(units.split("+"))
                    self.rows.append((alias, position, number, form, key.endswith("*"), tuple(conditions)))
                    self.variant[alias, position, number] = form
                    if key.endswith("*"):
                        self.default[alias, position] = form
                    for c in conditions:
                        self.conditional.setdefault((alias, position, c), form)
        self.masculine, self.feminine, self.neuter = map(frozenset, (MASCULINE, FEMININE, NEUTER))
        self.vowels = self.masculine | self.feminine | self.neuter
        self.consonants = frozenset(self.char) - self.vowels
        self.particles = {tuple(k.split()): tuple(map(int, v.split(","))) for k, v in (p.strip().split(":") for p in PARTICLES.split(";"))}
        self.encode = {(p, tuple(k.split("+"))): self._spelt(v) for p, row in REVERSE.items() for k, v in (x.split("=") for x in row.split())}
        self.encode_feminine = {(p, k): self._spelt(v) for p, row in REVERSE_FEMININE.items() for k, v in (x.split("=") for x in row.split())}
        self.longest = max(len(k) for _, k in self.encode)
        self.known = frozenset(u for _, k in self.encode for u in k) | frozenset(STRUCTURAL)
        self.positioned = frozenset((u, p) for p, row in POSITIONED.items() for u in row.split())
        self.alike = self._alike()

    def _spelt(self, text: str) -> tuple[str, str]:
        """(letter, its spelling with FVS)."""
        alias, number = (text, 0) if text in self.char else (text[:-1], int(text[-1]))
        return alias, self.char[alias] + (FVS[number] if number else "")

    def _alike(self) -> frozenset[tuple[str, str, str]]:
        """(unit, position, position) that look alike, closed under chains."""
        links: dict[str, list[set[str]]] = {}
        for a, b, row in (("init", "medi", SAME_INIT_MEDI), ("fina", "medi", SAME_FINA_MEDI), ("isol", "fina", SAME_ISOL_FINA), ("isol", "init", SAME_ISOL_INIT)):
            for unit in row.split():
                groups = links.setdefault(unit, [])
                touching = [g for g in groups if g & {a, b}]
                links[unit] = [g for g in groups if g not in touching] + [{a, b}.union(*touching)]
        return frozenset((u, p, q) for u, groups in links.items() for g in groups for p in g for q in g)


@cache
def catalogue() -> Catalogue:
    return Catalogue()


def checks() -> dict[str, int]:
    """Violations of what must hold of the tables; all are 0."""
    c = catalogue()
    defaults = [(a, p) for a, p, _, _, d, _ in c.rows if d]
    return {
        "letters without one alias": len(c.alias) - len(set(c.alias.values())),
        "repeated variants": len(c.rows) - len(c.variant),
        "positions without one default": abs(len(defaults) - 4 * len(c.char)) + len(defaults) - len(set(defaults)),
        "variants of no or many units": sum(not 1 <= len(u) <= 3 for _, _, _, u, _, _ in c.rows),
        "variants with controls": sum(bool(set(u) & set(STRUCTURAL)) for _, _, _, u, _, _ in c.rows),
        "particle places out of range": sum(max(v) >= len(k) for k, v in c.particles.items()),
    }
