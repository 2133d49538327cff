"""The built-in title catalogue."""

from __future__ import annotations

# ---- fixed values: canonical name | kind | year | aliases, in order (of repeated names the last row is listed, of
# repeated aliases the first one holds)

TITLES = """
Solo Leveling | manhwa | 2018 | sololeveling; solo levelling; na honjaman lebel-eop; only i level up
Tower of God | manhwa | 2010 | tog; sings; kami no tou
The Beginning After the End | manhwa | 2018 | tbate; beginning after the end
Omniscient Reader's Viewpoint | manhwa | 2018 | orv; omniscient reader; omniscient readers viewpoint; jeonjijeok dokja sijeom
Lookism | manhwa | 2014 | oemo jisangjuui
The God of High School | manhwa | 2011 | gohs; god of highschool
Noblesse | manhwa | 2007 |
Sweet Home | manhwa | 2017 |
Nano Machine | manhwa | 2020 | nanomachine
Eleceed | manhwa | 2018 |
Second Life Ranker | manhwa | 2017 | ranker who lives a second time; slr
Return of the Mount Hua Sect | manhwa | 2021 | romhs; mount hua sect; return of mount hua
Villain to Kill | manhwa | 2020 | vtk
Bastard | manhwa | 2014 |
Reaper of the Drifting Moon | manhwa | 2021 |
Attack on Titan | manga | 2009 | aot; shingeki no kyojin; snk; attack titan
Jujutsu Kaisen | manga | 2018 | jjk; jujitsu kaisen; jujutsu
One Punch Man | manga | 2009 | opm; onepunch man; one-punch man; saitama
Berserk | manga | 1989 |
Vagabond | manga | 1998 |
Vinland Saga | manga | 2005 | vs
Chainsaw Man | manga | 2018 | csm; chainsawman
Hunter x Hunter | manga | 1998 | hxh; hunter hunter
Monster | manga | 1994 | naoki urasawa monster
Oyasumi Punpun | manga | 2007 | goodnight punpun; punpun
Death Note | manga | 2003 | dn
Fullmetal Alchemist | manga | 2001 | fma; fmab; fullmetal alchemist brotherhood
Blue Lock | manga | 2018 | bluelock
Dungeon Meshi | manga | 2014 | delicious in dungeon; dunmeshi
Lore Olympus | webtoon | 2018 |
Let's Play | webtoon | 2017 | lets play
unOrdinary | webtoon | 2016 | unordinary
True Beauty | webtoon | 2018 |
Interstellar | movie | 2014 |
Parasite | movie | 2019 | gisaengchung
Everything Everywhere All at Once | movie | 2022 | eeaao; everything everywhere
Blade Runner 2049 | movie | 2017 | br2049; blade runner
The Prestige | movie | 2006 |
Oldboy | movie | 2003 | old boy
Whiplash | movie | 2014 |
Arrival | movie | 2016 |
Dune | book | 1965 | dune frank herbert
The Name of the Wind | book | 2007 | notw; name of the wind; kingkiller
Project Hail Mary | book | 2021 | phm; hail mary
Blood Meridian | book | 1985 |
The Three-Body Problem | book | 2008 | three body problem; 3 body problem; tbp
Piranesi | book | 2020 |
One Piece | manga | 1997 | op; onepiece
The Boxer | manhwa | 2019 | boxer
Ember Knight | manhwa | 2020 |
Viral Hit | manhwa | 2020 | how to fight; naneun nareul jeongbihanda
Legend of the Northern Blade | manhwa | 2019 | lotnb; northern blade; lotn
SSS-Class Suicide Hunter | manhwa | 2020 | sss class suicide hunter; suicide hunter; sss class revival hunter; revival hunter
Shotgun Boy | manhwa | 2020 | shot gun boy
Pigpen | manhwa | 2021 |
Medical Return | manhwa | 2018 |
Manager Kim | manhwa | 2021 |
Pyramid Game | manhwa | 2020 |
The Book Eater | manhwa | 2021 | book eater
Regressor's Instruction Manual | manhwa | 2020 | regressor instruction manual; regressors instruction manual
Mushoku Tensei | manga | 2012 | mushoko tensei; jobless reincarnation
JoJo's Bizarre Adventure | manga | 1987 | jojo; jjba
20th Century Boys | manga | 1999 | 20thcb; 20th century boys
Wind Breaker | manhwa | 2013 | windbreaker
Weak Hero | manhwa | 2019 | weakhero
Get Schooled | manhwa | 2020 |
Study Group | manhwa | 2018 |
Vigilante | manhwa | 2020 |
Kengan Ashura | manga | 2012 | kengan
Vagabond | manga | 1998 |
Slam Dunk | manga | 1990 | slamdunk
Demon Slayer | manga | 2016 | kimetsu no yaiba; kny
My Hero Academia | manga | 2014 | mha; boku no hero academia; bnha
Naruto | manga | 1999 |
Bleach | manga | 2001 |
Dragon Ball | manga | 1984 | dragonball; db; dbz
Tokyo Ghoul | manga | 2011 | tg
Made in Abyss | manga | 2012 | mia
Vinland Saga | manga | 2005 | vinland
"""


def rows() -> list[tuple[int, str, str, list[str], int]]:
    """(prio, canonical, kind, aliases, year)."""
    out = []
    for prio, line in enumerate(TITLES.strip().split("\n")):
        canonical, kind, year, aliases = (x.strip() for x in line.split("|"))
        out.append((prio, canonical, kind, [a.strip() for a in aliases.split(";") if a.strip()], int(year)))
    return out
