"""A little everyday prose in eight languages, written for training.

It adds to the labelled samples of a collection the small words, endings and
turns that any text of a language uses.
"""

PROSE = {
    "en": """
You can change your mind at any time, and we will not ask why you did so.
If this does not work for them, they should try it again with one of the others.
There are about three hundred of these, but each of them holds more than it did before.
What is it that she wants from him, and when will he be back with her answer?
Our list shows how many people came by train and how many had to walk all the way home.
By using this service you agree that some of your data may be kept for as long as we need them.
It was found quickly, because nobody else had been looking there for so many years.
The first thing that each new reader sees should be short, so that it can be read at once.
All rights to this text are held by those who wrote it, and it may be used only with their leave.
When something fails, the old copy is kept and the next one is made a few seconds later.
A man who has no time for his friends will soon have no friends to make time for.
He asked whether they would rather go out or stay in, although it was raining again.
Most of what we know about her life was put together from letters that were never sent.
Between you and me, I have never heard such a thing, nor do I think that it could be true.
They told us which of the boxes were full, which were empty and which had been lost.
Please read on to find out how much of it is left and where the rest has gone.
None of this would have been done without the help of everyone who gave a day of their own.
Those rules were made to be followed by whoever is in charge, not only by the new ones.
Its price went up each year, while its use went down, until hardly anyone bought it.
Tell others about this page, write to us with your thoughts, or sign up for our news.
We use cookies so that we can give you the best possible visit and see how our site is used.
The minutes of the last meeting list those who were there, those who were not, and one guest from abroad.
Every shop stores what it sells in one room per floor, so it can be brought down to the door at once.
""",
    "de": """
Sie können Ihre Wahl jederzeit ändern, und niemand wird Sie fragen, warum Sie das tun.
Wenn es so nicht geht, sollten wir es noch einmal mit einem anderen versuchen.
Davon gibt es etwa dreihundert, aber jeder enthält heute mehr als früher.
Was will sie denn von ihm, und wann kommt er mit ihrer Antwort zurück?
Durch die Nutzung dieser Seiten erklären Sie sich damit einverstanden, dass wir einige Daten speichern.
Alle Rechte an diesem Text liegen bei denen, die ihn geschrieben haben, und er darf nur mit Erlaubnis verwendet werden.
Er fragte, ob sie lieber ausgehen oder zu Hause bleiben wollten, obwohl es wieder regnete.
Das meiste, was wir über ihr Leben wissen, stammt aus Briefen, die nie abgeschickt wurden.
Zwischen den beiden Häusern stand ein alter Baum, unter dem im Sommer die Kinder spielten.
Nichts davon wäre ohne die Hilfe derer möglich gewesen, die einen Tag dafür gegeben haben.
Bitte lesen Sie weiter, um zu erfahren, wie viel noch übrig ist und wohin der Rest gekommen ist.
Wer keine Zeit für seine Freunde hat, der hat bald keine Freunde mehr.
Wir verwenden Cookies, um Ihnen den Besuch dieser Seiten so angenehm wie möglich zu machen.
Hat es dir gefallen? Dann sag es deinen Freunden oder schreib uns, was du davon hältst.
Mit jedem weiteren Besuch stimmen Sie dieser Verwendung der Daten zu.
""",
    "fr": """
Vous pouvez changer d'avis à tout moment, et nous ne vous demanderons pas pourquoi.
Si cela ne marche pas pour eux, ils devraient essayer encore une fois avec un autre.
Il y en a environ trois cents, mais chacun contient plus de choses qu'avant.
Que veut-elle de lui, et quand sera-t-il de retour avec sa réponse ?
En utilisant ce service, vous acceptez que certaines de vos données soient gardées par nos soins.
Tous les droits sur ce texte appartiennent à ceux qui l'ont écrit et il ne peut être utilisé sans leur accord.
Elle a demandé s'ils préféraient sortir ou rester chez eux, bien qu'il pleuve de nouveau.
Ce que nous savons de sa vie vient surtout de lettres qui n'ont jamais été envoyées.
Entre les deux maisons se trouvait un vieil arbre sous lequel les enfants jouaient en été.
Rien de tout cela n'aurait été possible sans l'aide de tous ceux qui ont donné une journée.
Nous et nos partenaires plaçons de petits fichiers sur votre appareil pour compter les visites.
Celui qui n'a pas de temps pour ses amis n'aura bientôt plus d'amis.
Nous utilisons des cookies afin de vous offrir la meilleure visite possible de nos pages.
Ce texte vous a plu ? Dites-le à vos amis ou écrivez-nous ce que vous en pensez.
Il utilise une autre langue afin de se faire mieux comprendre, et cela lui réussit.
Toute autre utilisation des textes et des images de ce site est interdite.
""",
    "es": """
Usted puede cambiar de opinión en cualquier momento y no le preguntaremos por qué lo hizo.
Si esto no les funciona, deberían intentarlo otra vez con uno de los otros.
Hay unos trescientos de estos, pero cada uno contiene más cosas que antes.
¿Qué quiere ella de él, y cuándo volverá con su respuesta?
Al usar este servicio, usted acepta que algunos de sus datos se guarden todo el tiempo necesario.
Todos los derechos de este texto son de quienes lo escribieron y solo puede usarse con su permiso.
Preguntó si preferían salir o quedarse en casa, aunque estaba lloviendo otra vez.
La mayor parte de lo que sabemos de su vida viene de cartas que nunca se enviaron.
Entre las dos casas había un árbol viejo bajo el cual jugaban los niños en verano.
Nada de esto habría sido posible sin la ayuda de todos los que dieron un día de los suyos.
Nosotros y nuestros socios guardamos pequeños archivos en su equipo para contar las visitas.
Quien no tiene tiempo para sus amigos pronto no tendrá amigos.
Usamos cookies para que su visita sea lo mejor posible y para saber cómo se usan estas páginas.
¿Le gustó este texto? Dígaselo a sus amigos o escríbanos lo que piensa.
Toda otra utilización de los textos y de las imágenes de este sitio está prohibida.
""",
    "it": """
Potete cambiare idea in qualsiasi momento e nessuno vi chiederà perché lo avete fatto.
Se questo non funziona per loro, dovrebbero provare ancora una volta con uno degli altri.
Ce ne sono circa trecento, ma ciascuno di essi contiene più cose di prima.
Che cosa vuole lei da lui, e quando tornerà con la sua risposta?
Usando questo servizio si accetta che alcuni dei propri dati siano conservati per tutto il tempo necessario.
Tutti i diritti su questo testo sono di chi lo ha scritto e può essere usato soltanto con il suo permesso.
Chiese se preferivano uscire o restare a casa, anche se pioveva di nuovo.
La maggior parte di quello che sappiamo della sua vita viene da lettere che non furono mai spedite.
Fra le due case c'era un vecchio albero sotto il quale d'estate giocavano i bambini.
Niente di tutto ciò sarebbe stato possibile senza l'aiuto di quelli che hanno dato una giornata.
Noi e i nostri amici mettiamo dei piccoli file sul vostro apparecchio per contare le visite.
Chi non ha tempo per gli amici presto non avrà più amici.
Usiamo i cookie per offrirvi la migliore visita possibile di queste pagine.
Vi è piaciuto questo testo? Ditelo agli amici oppure scriveteci che cosa ne pensate.
Secondo lei la strada era già stata chiusa durante la notte, a causa della neve.
Ogni altra utilizzazione dei testi e delle immagini di questo sito è vietata.
""",
    "nl": """
U kunt op elk moment van gedachten veranderen, en niemand zal vragen waarom u dat doet.
Als dit voor hen niet werkt, moeten ze het nog een keer met een van de andere proberen.
Er zijn er ongeveer driehonderd van, maar elk daarvan bevat meer dan vroeger.
Wat wil zij eigenlijk van hem, en wanneer komt hij met haar antwoord terug?
Door deze dienst te gebruiken gaat u ermee akkoord dat wij sommige van uw gegevens bewaren.
Alle rechten op deze tekst horen bij wie hem geschreven heeft, en hij mag alleen met toestemming worden gebruikt.
Hij vroeg of ze liever uitgingen of thuis bleven, hoewel het weer regende.
Het meeste wat we over haar leven weten, komt uit brieven die nooit zijn verstuurd.
Tussen de twee huizen stond een oude boom waaronder de kinderen in de zomer speelden.
Niets daarvan zou mogelijk zijn geweest zonder de hulp van iedereen die een dag heeft gegeven.
Wij en onze partners plaatsen kleine bestanden op uw apparaat om de bezoeken te tellen.
Wie geen tijd voor zijn vrienden heeft, heeft straks geen vrienden meer.
Wij gebruiken cookies om uw bezoek aan deze pagina's zo prettig mogelijk te maken.
Was dit stuk de moeite waard? Zeg het tegen uw vrienden of schrijf ons wat u ervan vindt.
Elk ander gebruik van de teksten en beelden op deze site is verboden.
""",
    "pt": """
Você pode mudar de opinião a qualquer momento e não vamos perguntar por que fez isso.
Se isto não funciona para eles, deveriam tentar mais uma vez com um dos outros.
Há cerca de trezentos destes, mas cada um deles contém mais coisas do que antes.
O que ela quer dele, e quando ele vai voltar com a resposta?
Ao usar este serviço, você aceita que alguns dos seus dados sejam guardados pelo tempo necessário.
Todos os direitos sobre este texto são de quem o escreveu e ele só pode ser usado com a sua licença.
Perguntou se preferiam sair ou ficar em casa, embora estivesse chovendo outra vez.
A maior parte do que sabemos sobre a sua vida vem de cartas que nunca foram enviadas.
Entre as duas casas havia uma árvore velha debaixo da qual as crianças brincavam no verão.
Nada disso teria sido possível sem a ajuda de todos os que deram um dia dos seus.
Nós e os nossos parceiros guardamos pequenos ficheiros no seu aparelho para contar as visitas.
Quem não tem tempo para os seus amigos em breve não terá amigos.
Usamos cookies para que a sua visita seja a melhor possível e para saber como se usam estas páginas.
Gostou deste texto? Diga aos seus amigos ou escreva para nós o que acha dele.
Foi naquele ano que as duas ruas foram ligadas uma à outra, perto do rio.
Toda outra utilização dos textos e das imagens deste sítio é proibida.
""",
    "ru": """
Вы можете передумать в любое время, и никто не спросит вас, почему вы так сделали.
Если это у них не получится, им стоит попробовать ещё раз с чем-нибудь другим.
Их всего около трёхсот, но в каждом теперь больше, чем было раньше.
Чего же она от него хочет, и когда он вернётся с её ответом?
Пользуясь этим сайтом, вы соглашаетесь с тем, что мы храним некоторые ваши данные.
Все права на этот текст принадлежат тем, кто его написал, и его нельзя использовать без разрешения.
Он спросил, хотят ли они выйти или останутся дома, хотя снова шёл дождь.
Почти всё, что мы знаем о её жизни, взято из писем, которые так и не были отправлены.
Между двумя домами стояло старое дерево, под которым летом играли дети.
Мы и наши партнёры сохраняем небольшие файлы на вашем устройстве, чтобы считать посещения.
Мы используем файлы cookie, чтобы сделать посещение этих страниц как можно удобнее.
Вам понравился этот текст? Расскажите о нём друзьям или напишите нам, что вы о нём думаете.
Любое другое использование текстов и изображений этого сайта запрещено.
""",
}


def lines() -> tuple[list[str], list[str]]:
    """All lines and their languages."""
    pairs = [(t, lang) for lang, text in PROSE.items() for t in text.strip().splitlines()]
    return [t for t, _ in pairs], [lang for _, lang in pairs]
