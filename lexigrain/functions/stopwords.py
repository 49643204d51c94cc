"""Short lists of function words, by language."""

from __future__ import annotations

_LISTS = {
    "english": """
        i you he she it we they me him her us them my your his its our their mine yours hers ours theirs
        myself yourself himself herself itself ourselves yourselves themselves who whom whose which what that this those these
        be am is are was were been being have has had having do does did doing done can could will would shall should may might must ought cannot
        a an the and or nor but if than then else so because while although though until unless whether as
        at by for from in into of off on onto out over to under up upon with within without about above across after against along among around before behind below beneath beside between beyond down during since through throughout toward towards via
        not no yes any all both each every few many more most much other others another own same some such several only very too just also even ever never again further once here there when where why how now
    """,
    "german": """
        ich du er sie es wir ihr mich dich ihn uns euch mir dir ihm ihnen sich mein dein sein unser euer kein
        der die das den dem des ein eine einen einem einer eines und oder aber denn weil dass ob wenn als wie
        in im an am auf aus bei beim mit nach von vom vor zu zum zur unter gegen durch für ohne um bis
        ist sind war waren bin bist wird werden wurde hat haben hatte kann können soll muss nicht noch nur auch schon sehr so da hier dort
        was wer wo dieser diese dieses jeder jede jedes alle alles man viel mehr
    """,
    "french": """
        je tu il elle nous vous ils elles me te se lui leur moi toi soi ce cela ça ceci cette cet ces
        le la les un une des du de d l au aux et ou mais donc or ni car si que qui quoi dont où quand comme
        dans par pour avec sans sous sur entre vers chez en à est sont était être ont avait avoir a
        mon ton son ma ta sa mes tes ses notre votre nos vos leurs ne pas plus très bien tout tous toute toutes même aussi
    """,
    "spanish": """
        yo tú él ella nosotros ellos ellas me te se le les nos lo la los las un una unos unas el al del de
        y e o u pero porque si que quien cual como cuando donde en con sin por para entre sobre hasta desde hacia
        es son era fue ser está están ha han había muy más menos ya no sí también este esta estos estas ese esa eso mi tu su sus
    """,
    "italian": """
        io tu lui lei noi voi loro mi ti si ci vi lo la li le gli il i un uno una di a da in con su per tra fra
        del della dei delle al alla ai alle dal dalla nel nella sul sulla e o ma se che chi cui come quando dove perché
        è sono era essere ho ha hanno avere non più molto anche questo questa quello quella mio tuo suo nostro vostro
    """,
    "dutch": """
        ik jij je hij zij ze wij we jullie mij me jou hem haar ons hen hun mijn zijn uw de het een en of maar want omdat als dat die dit deze
        in op aan uit bij met naar van voor door over onder tot tegen te om is was waren ben bent worden wordt heeft hebben had kan kunnen zal moet
        niet geen wel ook nog al maar zo er hier daar wie wat waar hoe wanneer alle alles meer veel zeer
    """,
    "croatian": """
        ja ti on ona ono mi vi oni one me te ga je nas vas ih mu joj nam vam im se svoj moj tvoj naš vaš
        i ili a ali pa da ako jer kad kada gdje kako što tko koji koja koje u na o po za od do iz s sa pri pod nad kroz bez
        sam si smo ste su bio bila biti nije nisu ne već još samo vrlo sve taj ta to ovaj ova ovo
    """,
    "latvian": """
        es tu viņš viņa mēs jūs viņi viņas man tev mani tevi sev savs šis šī tas tā tie un vai bet jo ja ka lai kad kur kā kas
        ar bez no uz pa pie pēc pirms par pret starp zem virs līdz ir bija būs būt nav ne arī vēl jau tikai ļoti viss visi
    """,
    "russian": """
        я ты он она оно мы вы они меня тебя его её нас вас их мне тебе ему ей нам вам им себя мой твой наш ваш свой
        и или а но да что чтобы если как когда где кто который в во на о об по за от до из с со к ко у при под над без для
        был была было были быть есть нет не ни же ли бы уже ещё только очень все всё это этот эта эти тот та те
    """,
    "ukrainian": """
        я ти він вона воно ми ви вони мене тебе його її нас вас їх мені тобі йому їй нам вам їм себе мій твій наш ваш свій
        і й та або а але що щоб якщо як коли де хто який у в на о об по за від до із з зі при під над без для
        був була було були бути є немає не ні же чи би вже ще тільки дуже всі все це цей ця ці той та ті
    """,
}

STOPWORDS: dict[str, frozenset[str]] = {language: frozenset(words.split()) for language, words in _LISTS.items()}


def stopwords(language: str) -> frozenset[str]:
    if language not in STOPWORDS:
        raise ValueError(f"no stop words for {language}")
    return STOPWORDS[language]
