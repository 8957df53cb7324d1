"""Sentences written by hand to measure the field for personal data; none is made by its labelled table.

<type|text> marks personal data: e email, p phone, i id_number, a address, n name.
"""

ORDINARY = """
<n|Barack Obama> spoke in Chicago last night.
My doctor is called <n|Kwame Mensah> and his number is <p|020 7946 0958>.
Angela's office said that <n|Angela Merkel> would not comment.
We met <n|Zhang Wei> at the conference in Boston.
If you are lost, ring <p|5551234> and ask for help.
You can write to <e|jane.doe@company.co.uk> about the refund.
The White House is at <a|1600 Pennsylvania Avenue, Washington>.
She moved to <a|221 Baker Street, London> in 1999.
The bill was sent to <n|Margaret Thatcher> by mistake.
Please forward it to <e|sales_team@acme-widgets.com> today.
My passport number is <i|K12345678>.
His social security number is <i|078-05-1120>.
The landlord, <n|Patrick O'Brien>, wants the rent on Monday.
I asked <n|Emily Watson> and <n|Chris Lindgren> to review it.
Our hotline is <p|+1 800 555 0199>.
The museum opens at 9:30 and closes at 18:00.
Apple released a new phone in September.
The Supreme Court will hear the case in March.
It costs 1,250 dollars, plus 8.5 percent tax.
The Great Wall of China is over 20,000 kilometres long.
Chapter 12 begins on page 345.
Oxford Street was crowded on Saturday.
We drove from New York to Los Angeles in five days.
Newton's laws were published in 1687.
Send your CV to <e|hr@northwind.io> or call <p|(212) 555-0187>.
My old flat was at <a|45 Elm Road, Brighton>.
The coach, <n|Diego Simeone>, was sent off.
Thanks, <n|Rebecca Stone>
His driver's licence <i|D1234567> has expired.
The meeting with <n|Satya Nadella> is on Tuesday.
Gestern traf ich <n|Heinrich Böll> im Zug nach Köln.
Meine Schwester heißt <n|Katharina Vogel> und wohnt in Bremen.
Rufen Sie mich unter <p|0171 2345678> an.
Die Rechnung geht an <n|Matthias Brandt>.
Schreiben Sie bitte an <e|kontakt@buchladen-nord.de>.
Unser Büro ist in der <a|Lindenstraße 14, 10969 Berlin>.
Ich wohne in der <a|Goethestraße 7>.
Meine Ausweisnummer ist <i|T22000129>.
Der Autor <n|Thomas Mann> starb in Zürich.
Herr <n|Stefan Krause> hat gestern angerufen.
Die Polizei fand den Ausweis von <n|Lena Meyer>.
Der Zug fährt um 14:35 von Gleis 7.
Das Brandenburger Tor steht in Berlin.
Die Deutsche Bahn erhöht die Preise um 4,9 Prozent.
Im Januar fielen 35 Zentimeter Schnee.
Die Universität Heidelberg hat 30.000 Studenten.
Am Montag beginnt die Schule wieder.
Der Erste Weltkrieg begann 1914.
Seine Nummer ist <p|+49 89 1234567>.
Frau <n|Ursula von der Leyen> sprach in Brüssel.
Fragen beantwortet <n|Jonas Weber> unter <p|030 9876543>.
Das Paket ging an die <a|Hauptstraße 23, 50667 Köln>.
Meine Steuernummer lautet <i|12345678901>.
Grüße, <n|Anke Petersen>
Der Roman von <n|Günter Grass> ist lang.
Hier, <n|Emmanuel Macron> a parlé à Strasbourg.
Mon voisin <n|Jean-Luc Dupont> est médecin.
Appelez-moi au <p|06 12 34 56 78> demain.
Écrivez-moi à <e|claire.martin@orange.fr> ce soir.
Elle habite au <a|12 rue de la Paix, 75002 Paris>.
J'ai déménagé au <a|8, avenue Victor Hugo, 69003 Lyon>.
Le numéro de mon passeport est <i|12AB34567>.
La lettre de <n|Simone Veil> est au musée.
Madame <n|Brigitte Bardot> vit dans le sud.
Le train part à 8h15 de la gare.
La Tour Eiffel mesure 330 mètres.
En 1998, la France a gagné la Coupe du Monde.
Le musée du Louvre est fermé le mardi.
La Banque de France a publié ses chiffres.
Il pleut souvent à Brest en novembre.
Ce livre coûte 25 euros et compte 400 pages.
Contactez <n|Amélie Poulain> au <p|01 42 68 53 00>.
Notre professeur, <n|Michel Foucault>, est absent.
Bien à vous, <n|Hélène Garnier>
Le docteur <n|Yves Morel> reçoit le lundi.
Nous avons invité <n|Léa Seydoux> et <n|Omar Sy>.
Envoyez tout à <e|support@boutique-soleil.fr> svp.
Ma carte d'identité est la <i|880692310285>.
Selon <n|Marine Renaud>, le pont est solide.
L'Union européenne compte 27 pays.
Ayer vi a <n|Penélope Cruz> en el teatro.
Mi hermano se llama <n|Rodrigo Fuentes> y vive en Lima.
Llame al <p|912 345 678> por la mañana.
Escríbeme a <e|lucia.mora@correo.es> mañana.
Vivo en la <a|Calle Mayor 15, 28013 Madrid>.
La tienda está en la <a|Avenida de América, 22, Valencia>.
Mi DNI es <i|12345678Z>.
El escritor <n|Gabriel García Márquez> nació en Colombia.
La doctora <n|Isabel Allende> no está hoy.
El señor <n|Pablo Neruda> compró la casa.
El tren sale a las 7:45 de Atocha.
La Sagrada Familia está en Barcelona.
En 2010 España ganó el mundial.
El Banco de España subió los tipos un 0,5 por ciento.
La Plaza Mayor estaba llena el domingo.
El libro tiene 320 páginas.
Buenos Aires es la capital de Argentina.
Según <n|Rosario Castellanos>, todo fue un error.
Atentamente, <n|Marcos Ibáñez>
Su número es el <p|+34 600 123 456>.
Mi pasaporte es el <i|AAB123456>.
Hablé con <n|Teresa Villanueva> y con <n|Óscar Jiménez>.
Manda el paquete a <a|Calle de Alcalá 50, Madrid>.
La Universidad de Salamanca es antigua.
El contrato lo firmó <n|Esteban Quiroga>.
Ontem encontrei <n|Cristiano Ronaldo> no aeroporto.
A minha prima chama-se <n|Mariana Lopes> e mora no Porto.
Ligue para <p|21 345 67 89> depois das nove.
Escreva para <e|joana.reis@correio.pt> amanhã.
Moro na <a|Rua Augusta 100, 1100-053 Lisboa>.
O escritório fica na <a|Avenida Paulista, 1578, São Paulo>.
O meu CPF é <i|123.456.789-09>.
O escritor <n|José Saramago> nasceu na Azinhaga.
A doutora <n|Fernanda Montenegro> não atende hoje.
O senhor <n|Rui Tavares> comprou o carro.
O comboio parte às 6h50 da estação.
A Torre de Belém fica em Lisboa.
Em 2016 Portugal ganhou o europeu.
O Banco de Portugal publicou o relatório.
O livro custa 18 euros e tem 250 páginas.
A Universidade de Coimbra é antiga.
O Rio de Janeiro recebe muitos turistas.
Segundo <n|Clarice Lispector>, o mar é livre.
Cumprimentos, <n|Helena Barbosa>
O número dela é <p|+55 11 91234-5678>.
O meu passaporte é o <i|CB123456>.
Falei com <n|Duarte Nogueira> e com <n|Sílvia Prado>.
A carta foi escrita por <n|Fernando Pessoa>.
No Natal neva na serra.
O contrato foi assinado por <n|Gonçalo Mendes>.
Вчера <n|Владимир Путин> выступил в Москве.
Мою сестру зовут <n|Екатерина Белова>, она живёт в Казани.
Звоните по номеру <p|+7 495 123-45-67> утром.
Пишите на <e|info@knigi-online.ru> в любое время.
Мы живём по адресу <a|ул. Ленина, д. 5, кв. 12>.
Офис находится на <a|ул. Тверская, д. 18>.
Мой паспорт: <i|4509 123456>.
Писатель <n|Лев Толстой> жил в Ясной Поляне.
Доктор <n|Антон Чехов> сегодня не принимает.
Господин <n|Игорь Стравинский> купил дом.
Поезд отправляется в 9:40 с третьего пути.
Красная площадь находится в Москве.
В 1961 году человек полетел в космос.
Банк России повысил ставку на 0,5 процента.
В книге 280 страниц.
Байкал — самое глубокое озеро.
Зимой в Якутске очень холодно.
По словам <n|Анны Ахматовой>, город спал.
С уважением, <n|Наталья Громова>
Его номер <p|8 (916) 123-45-67>.
Я говорил с <n|Андреем Мироновым> вчера.
Письмо написал <n|Осип Мандельштам>.
Московский университет открыт в 1755 году.
Договор подписал <n|Сергей Лазарев>.
Нева впадает в Финский залив.
昨天我见到了<n|王小明>。
我的医生叫<n|李建国>，他很好。
请打电话<p|13912345678>找我。
我的邮箱是<e|xiaoming@sina.com.cn>。
我家住在<a|中山路88号>。
公司地址是<a|建国路12号>。
我的护照号是<i|E12345678>。
我的身份证号是<i|11010519491231002X>。
作家<n|鲁迅>出生在绍兴。
<n|张艺谋>导演拍了这部电影。
火车九点半开。
长城有两万多公里长。
二零零八年北京举办了奥运会。
这本书有三百页，卖25元。
中国银行公布了报告。
清华大学在北京。
今天下雨，我们不去公园。
上海有2400万人。
<n|陈美玲>说她明天来。
请联系<n|刘德华>，电话<p|010-12345678>。
这封信是<n|赵丽颖>写的。
我和<n|周杰伦>是同学。
冬天哈尔滨很冷。
我们去年去了西湖。
合同由<n|马化腾>签字。
昨日<n|山田太郎>さんに会いました。
私の先生は<n|鈴木一郎>です。
電話は<p|03-1234-5678>までお願いします。
メールは<e|taro@yamada.co.jp>に送ってください。
住所は<a|港区2丁目3番地>です。
私のパスポートは<i|TK1234567>です。
作家の<n|村上春樹>は京都で生まれた。
<n|黒澤明>監督の映画を見た。
電車は九時に出ます。
富士山は日本で一番高い山です。
一九六四年に東京でオリンピックが開かれた。
この本は三百ページあります。
日本銀行が報告を発表した。
京都大学は古い大学です。
今日は雨なので家にいます。
大阪には270万人が住んでいる。
<n|佐藤健>さんは明日来ます。
連絡先は<n|中村優子>、電話は<p|090-1234-5678>です。
この手紙は<n|夏目漱石>が書いた。
私は<n|高橋大輔>と同級生です。
冬の札幌はとても寒い。
去年、奈良へ行きました。
契約書は<n|渡辺謙>が署名した。
明日の会議は三時からです。
新しい駅は来年できます。
""".strip()
KINDS = {"e": "email", "p": "phone", "i": "id_number", "a": "address", "n": "name"}


def parsed() -> list[tuple[str, set[tuple[int, int, str]]]]:
    """(text, spans) of every sentence."""
    import re

    out = []
    for line in ORDINARY.split("\n"):
        text, spans, at = "", set(), 0
        for m in re.finditer(r"<([epian])\|([^<>]*)>", line):
            text += line[at : m.start()]
            spans.add((len(text), len(text) + len(m[2]), KINDS[m[1]]))
            text += m[2]
            at = m.end()
        out.append((text + line[at:], spans))
    return out
