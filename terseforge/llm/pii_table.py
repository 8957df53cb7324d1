"""The labelled table that the field for personal data is trained on.

Sentences written for this purpose, in eight languages, with slots: [x] stands for personal data of
type x, {x} for other text. Names, numbers and addresses are filled in by rule: partly from common
names, partly invented from syllables, so that the field learns shapes and surroundings and not a
list. Some sentences are close to those of the test tables; ``tests/llm`` measures the field on
sentences that are neither.
"""

from __future__ import annotations

import random
import re

# Common given names and surnames of many countries.
GIVEN = """Ada Bruno Clara Dario Elif Emil Felix Frida Goran Greta Hana Hugo Ines Ivo Jana Jonas Karim Lena Lucia Marta Milo Mina Nadia Noor Olga Oskar Otto Pavel Petra Quentin Rafael Rosa Samir Stefan Tara Thea Tomas Ugo Vera Wanda Yara Zoe
Anna Peter Maria John Sofia Laura David Paul Julia James Mary Robert Linda Michael Sarah William Emma Thomas Alice Charles George Susan Daniel Karen Mark Helen Ahmed Fatima Omar Aisha Ali Ibrahim Yusuf Priya Ravi Arjun Anita Sanjay Wei Li Ming Hiroshi Yuki Kenji Akira Kim Nguyen
Jean Marie Pierre Claire Louis Camille Antoine Sophie Luc Hans Klaus Heike Ursula Jürgen Sabine Dieter Monika Carlos Carmen José Juan Pedro Pilar Miguel Ana João Beatriz Tiago Inês Luís Giulia Marco Paolo Ingrid Sven Lars Astrid Ivan Dmitri Svetlana Zofia Piotr Kofi Amara Chidi""".split()
SURNAMES = """Smith Johnson Brown Jones Miller Davis Wilson Taylor Clark Lewis Walker Young King Wright Hill Green Baker Carter Turner Parker Evans Collins Murphy Cook Morgan Bell Cooper Reed Bailey Kelly Howard Ward Cox Bennett Wood Barnes Ross Henderson
Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Neumann Zimmermann Krüger Hartmann Werner Martin Bernard Dubois Durand Leroy Moreau Simon Laurent Lefebvre Roux Fournier Girard Bonnet Lambert
García Martínez López Sánchez Pérez Gómez Fernández Ruiz Díaz Álvarez Romero Torres Navarro Ramos Silva Santos Oliveira Souza Pereira Costa Ferreira Almeida Carvalho Ribeiro Rossi Ferrari Bianchi Kowalski Nowak Horvat Novák Hansen Nielsen Larsen Andersson Virtanen Papadopoulos Yilmaz Hassan Khan Patel Singh Sharma Kumar Chen Wang Zhang Liu Park Lee Tanaka Suzuki Okafor Diallo Mbeki""".split()
SYLLABLES = "bel bra cle cor del dor dru eno fen flo gal gri hes hyl ilu jor ka kre lo lum mar mis nor ops pel pho qui ran rhi sal sun tor tri uma van vel vor wex xe yel zan zi du ke lu mi mon ne ra ro se so ta te vi go".split()
SURNAME_ENDS = "aardi aaro ardi aro berg ez hart iez lund mann nek oez off ova owick ski sen ström wick aez son er".split()
PLACE_ENDS = "bel dal dis gen ia lex lith mark mora nade net phos quist ria ric rin ster sum ton tor ven via".split()
# Capitalised phrases that are no person.
PLACES = ("New York", "Los Angeles", "San Francisco", "South Africa", "Great Britain", "Hong Kong", "North America", "Berlin", "Paris", "Madrid", "Lisbon", "Rome", "Vienna", "London", "Tokyo", "Chicago", "Boston", "Munich", "Hamburg", "Lyon", "Marseille", "Sevilla", "Porto", "Brazil", "Spain", "Germany", "France", "Canada", "Australia", "Supreme Court", "White House", "Eiffel Tower", "Golden Gate", "Central Park", "Harvard University", "Oxford University", "World Bank", "Red Cross", "European Union", "Google Maps", "Microsoft Word", "Nobel Prize", "Wall Street", "Times Square", "Lake Superior", "Mount Everest", "Star Wars", "Bank of England", "House of Commons", "Monte Carlo", "Costa Rica", "Sierra Leone", "Deutsche Bank", "Air France", "Real Madrid", "National Gallery", "Old Town", "Main Street", "Royal Society", "Daily Telegraph", "General Motors", "Ford", "Amazon", "Apple", "Linux", "Python", "Excel", "Toyota", "Siemens")
MONTHS = "January February March April May June July August September October November December".split()
RU_PLACES = "Москва Париж Берлин Казань Самара Новгород Саратов Лондон Россия Волга Урал Сибирь Газпром Яндекс".split()
ZH_PLACES = "北京 上海 广州 南京 香港 台湾 中国 美国 法国 德国 长江 黄河 杭州 成都 清华 西湖".split()
JA_PLACES = "東京 大阪 京都 名古屋 横浜 札幌 日本 福岡 神戸 奈良 富士山 早稲田 トヨタ ソニー アメリカ フランス".split()
_GIVEN_ZH = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华慧建文辉力鹏云海山仁波宁贵福生龙元全国胜学祥才发武新利清飞彬富顺信子杰涛昌成康星光天达安岩中茂进林有坚和彪博诚先敬震振壮会思群豪心邦承乐绍功松善厚庆"
FAMILY_NAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文池明柏"
_JA_FAMILY = "佐藤 鈴木 高橋 田中 伊藤 渡辺 山本 中村 小林 加藤 吉田 山田 佐々木 山口 松本 井上 木村 林 清水 斎藤 森 池田 橋本 石川 小川 岡田 長谷川 藤田 後藤 近藤 村上 遠藤 青木 坂本".split()
_JA_GIVEN = "翔太 健一 直樹 大輔 拓也 美咲 陽子 恵子 由美 智子 花子 太郎 一郎 次郎 真由美 香織 さくら あかり 誠 浩 学 彩 愛 結衣 蓮".split()
_JA_LETTERS = "樹明輔介郎子美香恵理優希真由大雄一正和義信幸弘太健誠浩学彩愛翔直拓"
_RU_LAST = "Иванов Петров Сидоров Смирнов Кузнецов Попов Васильев Соколов Михайлов Новиков Фёдоров Морозов Волков Алексеев Лебедев Семёнов Егоров Павлов Козлов Степанов".split()

# The labelled table. [x] marks personal data of type x, {x} is filled with other text.
LABELLED = """
My name is [name] and you can write to [email].
My name is [name] and I live at [address].
btw i am [name], ping me at [email]
btw i am [name] and my cell is [phone]
Is [email] still the right address for [name]?
Mr. [name] asked that we use [email] instead.
[name] asked that we use [email] instead.
Mrs. [name] and Dr. [name] were there.
Please call [name] on [phone] before noon.
Please call Ms. [name] on [phone] before noon.
The tenant, [name], moved to [address] last week.
I live at [address], so send it there.
Sign it with "[name], [address]" at the end.
Sign it with "[name], [address]" at the end.
Write "[name], [address]" on the box.
Thanks in advance, [name]
Best regards, [name]
SSN [id], name [name], phone [phone].
SSN [id], name [name], phone [phone].
SSN [id], name [name], phone [phone].
Name [name], SSN [id].
My passport says [id]; my phone is [phone].
For the form my id number is [id].
Reach me under [phone].
contact: [email] / [phone]
contact: [email] / [phone]
contact: [email] / [phone]
contact: [email] / [phone] {en}
Reply to [email] or ring [phone] after six.
[name], [address]
[name]
[address]
[email]
[phone]
Je m'appelle [name] et mon adresse est [address_fr].
Écrivez à [email] ou appelez le [phone].
Mon numéro de carte est [id].
Cordialement, [name]
M. [name] habite [address_fr].
Ich heiße [name] und wohne in der Nähe: [address_de].
Bitte schreiben Sie an [email] oder rufen Sie [phone] an.
Meine Ausweisnummer lautet [id].
Mit freundlichen Grüßen, [name]
Mit freundlichen Grüßen, [name]
Mit freundlichen Grüßen, [name]
Thanks in advance, [name]
Frau [name] wohnt in der {Dp} nicht mehr, sondern: [address_de].
Me llamo [name] y vivo en [address_es].
Escriba a [email] o llame al [phone].
Mi documento es [id].
Saludos cordiales, [name]
O meu nome é [name] e moro em [address_es].
Escreva para [email] ou ligue para [phone].
O meu documento é [id].
Com os melhores cumprimentos, [name]
Пишите на [email] или звоните [phone].
Номер моего паспорта [id].
Меня зовут [name_ru], мой телефон [phone].
Меня зовут [name_ru], мой адрес: [address_ru].
Меня зовут [name_ru], мой адрес: [address_ru].
Меня зовут [name_ru], мой адрес: [address_ru].
Номер паспорта: [id].
С уважением, [name_ru]
Я живу по адресу [address_ru], пишите.
我叫[name_zh]，住在[address_zh]。
我叫[name_zh]，住在[address_zh]。
我叫[name_zh]，住在[address_zh]。
我的名字是[name_zh]，地址是[address_zh]。
私は[name_ja]です。住所は[address_ja]です。
私の名前は[name_ja]です。
请写信到 [email] 或致电 [phone] 。
我的证件号是 [id] 。
メールは [email] 、電話は [phone] です。
私の番号は [id] です。
I spoke with [name] about it yesterday.
According to [name], the plan was never approved.
[name] joined the company in {y} as an engineer.
[name] and [name] were married in {G}.
The report was written by [name] and edited by [name].
President [name] met Chancellor [name] in {G} on Monday.
We invited [name], [name] and [name] to the meeting.
Did you hear what [name] said about {G}?
[name]'s phone number is [phone], I think.
You can reach my lawyer, [name], at [phone].
Call me at [phone] when you get home.
My number is [phone], text me any time.
Our office line is [phone] and the fax is [phone].
Tel: [phone]
Phone: [phone], e-mail: [email]
Send the files to [email] before Friday.
Email me: [email]
Her address is [address] and her number is [phone].
She lives at [address] with her parents.
We moved from {G} to [address] in {y}.
Ship the parcel to [address], please.
The meeting is at [address].
My passport number is [id].
Passport no. [id], issued in {G}.
My social security number is [id].
Driver's licence [id] expires in {y}.
Please transfer the money to IBAN [id].
His ID card [id] was stolen in {G}.
Tax number: [id]
Dear [name], thank you for your letter.
Hi [name], can you call [phone]?
Yours sincerely, [name]
The singer [name] was born in {G}.
"I never said that," [name] told reporters.
Actor [name] plays the doctor in it.
My boss [name] lives in {G}.
The patient, [name], was seen on {date}.
Contact person: [name], [phone], [email]
From: [name] <[email]>
It was [name] who found the keys.
Yesterday [name] called from [phone].
My neighbour [name] has a dog.
In {y} [name] won the {G} prize.
Gestern habe ich mit [name] gesprochen.
Laut [name] wurde der Plan nie genehmigt.
[name] wurde in {G} geboren.
Herr [name] und Frau [name] wohnen in {G}.
Bundeskanzlerin [name] reiste nach {G}.
Meine Telefonnummer ist [phone].
Sie erreichen mich unter [phone] oder [email].
Tel.: [phone]
Wir wohnen in der [address_de].
Meine Adresse ist [address_de].
Meine Reisepassnummer ist [id].
Meine IBAN lautet [id].
Lieber [name], vielen Dank für den Brief.
Das Buch hat [name] geschrieben.
Viele Grüße von [name]
Kommst du mit [name] nach {G}?
Hier wohnt [name], [address_de].
Hier, il a parlé avec [name] du projet.
Selon [name], le plan était mauvais.
[name] est né à {G} en {y}.
Monsieur [name] et Madame [name] habitent à {G}.
Mon numéro de téléphone est le [phone].
Appelez-moi au [phone] ce soir.
Tél. : [phone]
J'habite au [address_fr].
Nous habitons [address_fr].
Mon passeport porte le numéro [id].
Le livre a été écrit par [name].
Cher [name], merci pour votre lettre.
Le président [name] a rencontré [name] à {G}.
Ma voisine [name] a un chien.
Ayer hablé con [name] sobre el plan.
Según [name], el proyecto era caro.
[name] nació en {G} en {y}.
El señor [name] vive en {G}.
Mi número de teléfono es el [phone].
Llámame al [phone] esta noche.
Vivo en la [address_es].
Mi dirección es [address_es].
Mi pasaporte es el [id].
Mi DNI es [id].
El libro fue escrito por [name].
Querido [name], gracias por tu carta.
La presidenta [name] viajó a {G}.
Mi vecino [name] tiene un perro.
Ontem falei com [name] sobre o plano.
Segundo [name], o projeto era caro.
[name] nasceu em {G} em {y}.
O senhor [name] mora em {G}.
O meu número de telefone é [phone].
Ligue-me para o [phone] à noite.
Moro na [address_pt].
O meu endereço é [address_pt].
O meu passaporte é o [id].
O meu CPF é [id].
O livro foi escrito por [name].
Querido [name], obrigado pela carta.
A presidente [name] viajou para {G}.
A minha vizinha [name] tem um cão.
Вчера я говорил с [name_ru] о плане.
По словам [name_ru], план был дорогим.
[name_ru] родился в городе {RG}.
Господин [name_ru] живёт в {RG}.
Мой телефон: [phone].
Позвоните мне по номеру [phone] вечером.
Мой адрес: [address_ru].
Мы живём на [address_ru].
Паспорт [id] выдан в {RG}.
Книгу написал [name_ru].
Уважаемый [name_ru], спасибо за письмо.
Президент [name_ru] приехал в {RG}.
Напишите мне на [email].
昨天我和[name_zh]谈了这个计划。
[name_zh]出生在{CG}。
据[name_zh]说，这个计划很贵。
[name_zh]先生住在{CG}。
这本书是[name_zh]写的。
我的电话是[phone]。
请拨打[phone]联系我。
拨[phone]找[name_zh]。
手机号[phone]，谢谢。
请致电[phone]。
我的护照号码是[id]。
我住在[address_zh]。
地址：[address_zh]
请把包裹寄到[address_zh]。
邮箱是[email]。
联系人：[name_zh]，电话：[phone]
[name_zh]总统访问了{CG}。
身份证号：[id]
昨日[name_ja]さんと計画について話した。
[name_ja]は{JG}で生まれた。
[name_ja]さんは{JG}に住んでいる。
この本は[name_ja]が書いた。
電話番号は[phone]です。
[phone]に電話してください。
私のパスポート番号は[id]です。
[address_ja]に住んでいます。
住所：[address_ja]
メールアドレスは[email]です。
担当：[name_ja]、電話：[phone]
[name_ja]首相が{JG}を訪問した。
[name_ja]先生の授業は面白い。
[name_ja]監督の新しい映画は長い。
社長の[name_ja]が会議に出た。
絵は[name_ja]が描いた。
私と[name_ja]は友達です。
歌手の[name_ja]は来月来日する。
問い合わせ先は[name_ja]、メールは[email]です。
会社は[address_ja]にあります。
書類は[address_ja]へ送ってください。
詩人の[name_ja]は{JG}で亡くなった。
[name_ja]監督の作品を見る。
私と[name_ja]は同僚です。
私の免許証は[id]です。
手紙は[name_ja]が書いた。
電話は[phone]です。
[email]にご連絡ください。
[phone]までお電話ください。
番号は[phone]、名前は[name_ja]です。
免許証の番号は[id]です。
画家の[name_ja]と作家の[name_ja]が受賞した。
これは[name_ja]の作品です。
選手の[name_ja]が優勝した。
教授の[name_ja]は{JG}大学で教えている。
明日[name_ja]さんが来る。
[name_ja]が署名した手紙が届いた。
社长[name_zh]明天开会。
导演[name_zh]的新电影很长。
演员[name_zh]出生在{CG}。
画是[name_zh]画的。
我和[name_zh]是朋友。
歌手[name_zh]下个月来{CG}。
请找[name_zh]，邮箱[email]。
公司在[address_zh]。
文件请寄到[address_zh]。
请发邮件到[email]给我。
打[phone]找[name_zh]。
驾照号码是[id]。
[name_zh]说他后天来。
文件由[name_zh]签署。
昨晚我遇到了[name_zh]。
[name_zh]教授在{CG}大学教书。
老师叫[name_zh]。
我的同学[name_zh]住在{CG}。
[name_zh]导演来了。
护照[id]丢了。
诗人[name_zh]出生在{CG}。
画家[name_zh]很有名。
今天我看见了[name_zh]。
[name_ru] выступил в {RG} в понедельник.
Художник [name_ru] родился в {RG}.
Мой брат [name_ru] живёт в {RG}.
Сегодня [name_ru] уехал из {RG}.
Картину нарисовал [name_ru].
Мы встретили [name_ru] на вокзале.
Врач [name_ru] работает в {RG}.
Поэт [name_ru] умер в {RG}.
Актёр [name_ru] сегодня не играет.
Режиссёр [name_ru] снял фильм.
Учёный [name_ru] жил в {RG}.
Паспорт: [id]
Его зовут [name_ru], он юрист.
Номер телефона [phone], зовут [name_ru].
Серия и номер паспорта: [id].
Завтра [name_ru] приедет в {RG}.
Роман написала [name_ru].
С приветом, [name_ru]
[name] will speak at the conference on {date}.
The parcel was delivered to [name] by mistake.
We saw [name] at the station, then [name] left.
Best, [name]
Painter [name] died in {G}.
The mayor, [name], opened the {G}.
The goalkeeper, [name], was injured.
She asked [name] and [name] to help.
A talk with [name] is planned.
Dial [phone] for help.
His number is [phone] and hers is [phone].
Wählen Sie [phone] oder [phone].
Unter [phone] meldet sich [name].
電話[phone]、または[phone]まで。
If you need help, ring [phone] now.
The number [phone] is no longer in use.
Passports [id] and [id] were lost.
Ask for [name] at [address].
Die Einladung ging an [name] und [name].
Der Film von [name] läuft im Kino.
Meine Tante heißt [name] und lebt in {G}.
Heute kam [name] zu spät.
Anfragen nimmt [name] unter [phone] entgegen.
Liebe Grüße, [name]
Der Maler [name] starb in {G}.
Sein Ausweis [id] ist abgelaufen.
Wir ziehen in die [address_de].
Der Laden in der [address_de] ist zu.
Aujourd'hui, [name] a visité {G}.
Notre médecin, [name], est en vacances.
La chanson de [name] est belle.
Appelez [name] au [phone] avant midi.
Amicalement, [name]
Nous avons vu [name] et [name] au cinéma.
Le peintre [name] est mort à {G}.
Sa carte d'identité est la [id].
La maison est au [address_fr].
Écris à [email] demain.
Hoy [name] visitó {G}.
Nuestra médica, [name], está de vacaciones.
La canción de [name] es bonita.
Mi primo se llama [name] y vive en {G}.
Un saludo, [name]
Vimos a [name] y a [name] en el cine.
El acuerdo lo firmó [name].
El pintor [name] murió en {G}.
Escribe a [email] hoy.
La casa está en la [address_es].
Hoje [name] visitou {G}.
O nosso médico, [name], está de férias.
A canção de [name] é bonita.
O meu primo chama-se [name] e mora em {G}.
Abraços, [name]
Vimos [name] e [name] no cinema.
O acordo foi assinado por [name].
O pintor [name] morreu em {G}.
A casa fica na [address_pt].
O seu CPF é [id].
[name] {x} {x} {x} {x}.
[name] {x} {x} {G} {x}.
{X} {x} {x} [name] {x} {x}.
{X} {x} [name] {x} {x} {x} {x}.
{X} {x} {x} {x} [name].
{X}, [name] {x} {x} {G}.
{X} {x}, [name], {x} {x}.
{X} {x} [name] {x} [name] {x} {x}.
{x} {x} [name], {x} {x} {x}.
{X}, [name]
{X} {x} {x}, [name]
{X} [name] {x} {x} {x}.
{X} {x} {x}: [name], [phone]
{X} {x} {x} [phone] {x} {x}.
{X} {x} {x} {x} [email] {x}.
{X} {x} {x} [id].
{X} {x} {x} {x} [address].
{X} {x} {x} [address_de] {x}.
{X} {x} {x} [address_fr].
{X} {x} {x} [address_es].
{X} {x} [name] {x} {x} [name].
{XR} {xr} [name_ru] {xr} {xr}.
[name_ru] {xr} {xr} {xr}.
{XR} {xr} {xr} [name_ru].
{XR} [name_ru] {xr} {xr} {RG}.
{XR} {xr} [name_ru], {xr} {xr}.
{XR} {xr} {xr} [phone] {xr}.
{XR} {xr} {xr} [id].
"""
# Sentences without personal data, many of them shaped like some.
PLAIN = """
Order {d4}-{d4}-{d4} was for the {w}.
ISBN {d3}-{d1}-{d2}-{d4}-{d1} is the {w}.
Use foo@{d2}.{d2} as the revision, not an address.
Lane {d4} of the {w} was closed on {date}.
The range {d4} - {d4} covers {d3} {w}s.
Set ratio=0.{d2}, seed={d8}.
The run took {d2}:{d2}:{d2} on build {d1}.{d2}.{d1}-{d3}.
Ping @{l} in the channel about ticket #{d4}-{d4}.
The {P} Street Journal of {P} covers {w}s.
The {P} method of {P} reduces {d4} {w}s, not {d3}.
The {P} Lane theorem and the {P} Avenue conjecture share {d4} {w}s.
There are {d4} {w}s in the {w}, and {P} inspects every local one.
{P} supports convex {w}s, although the {w} mostly confirms the {w}s.
Both {P} and the rural {w} cost about {d4} {w}s without supervision.
Which {w} removes the robust {w}s of {P}?
Name the {w} that {P} delays.
Name the {w} of {P} and {P}.
Why is {P} called global in the {w}?
How many {w}s does the {P} {w} need by hand?
What does the silent {w} of {P} say about {w}s?
Does {P} explain how the fine {w} doubles {w}s?
However, each {w} holds {d4} fragile {w}s and one {P} {w}.
Moreover, the {w} between {P} and {P} restores {d4} {w}s.
The {w}, a toxic {w} from {P}, matches {d2}.{d3} of the {w}s.
To reach a sparse {w}, the {P} {w} limits {w}s in spring.
A northern {w} predicts {w}s with {d2}.{d3} percent fewer {w}s than {P}.
If the {w} is rapid, {P} quickly encodes the {w} of the {w}s.
In addition, {w}s and {w}s share the same popular {w} as {P}.
Version {d1}.{d2}.{d1} of {P} reads {P}.
Meanwhile, theory predicts that the {w} shifts {d3} {w}s, while {P} halves the {w}.
Zwischen {P} und {P} liegt das Dorf mit {d4} Einträgen.
Der Fluss stützt die neuen Regeln, obwohl {P} nur {d4} Einheiten liefert.
Warum verwirft die Schule aus {P} die lange Liste?
Rund {d2},{d3} Prozent der Fälle zeigen, dass {P} das alte Archiv ersetzt.
Die Anlage aus {P} kostet {d4} Kronen, aber das Gericht prüft den Entwurf.
Entre {P} et {P}, la revue garde {d4} entrées malgré le coût.
Le rapport venant de {P} coûte {d4} couronnes, mais le musée améliore la longue liste.
Combien de pièces {P} compte avant les travaux ?
La clinique fournit le vieux contrat, bien que {P} compte {d4} unités.
Entre {P} y {P}, el comité guarda {d4} entradas en primavera.
¿Cuántas piezas tiene {P} desde ayer?
El modelo que llegó de {P} cuesta {d4} coronas, pero la revista retrasa el borrador.
Entre {P} e {P}, o museu guarda {d4} entradas à noite.
O sensor que veio de {P} custa {d4} coroas, mas o jornal revê a lista.
Между {R} и {R} находится архив, где хранится {d4} записей.
Почему журнал из {R} проверяет общее среднее?
Метод ограничивает длинный список, хотя {R} даёт лишь {d4} единиц.
Тем не менее датчик из {R} отклоняет тихие голоса во всех районах.
Что говорит суд про {R}?
Около {d2},{d3} процента случаев показывают, что {R} заменяет правила.
在{C}和{C}之间，报告保存了{d4}条记录。
渔船来自{C}，价格是{d4}元，但是{C}测量了旧合同。
关于{C}，博物馆说了什么？
大约百分之{d2}.{d3}的情况表明{C}检查了第二个版本。
诊所改进了简短的回答，尽管{C}只有{d4}个单位。
学校限制了未解决的问题，尽管{C}只有{d3}个单位。
此外，共统计了{d4}件，因为编辑部描述了北方的港口。
在低温下，{C}解释了很长的名单，而渔船改进了密集的网络。
从昨天起，{C}测量了完整的上下文，而该方法限制了昂贵的机器。
深夜里，{C}推迟了很长的名单，而法院推迟了实验样品。
据报道，{C}的委员会收获季节里删除了平均误差。
这个模型来自{C}，价格是{d4}元，但是工程师支持了缺失的数值。
{C}在春天一共有多少条记录？
那里的名字很多，住在河边的人不多，号码是第{d2}个版本。
およそ{d2}.{d3}パーセントの例では{K}が残った問いを説明した。
収穫の時期に、{K}が平均誤差を拒んだ。
その後、{d4}件が数えられ、技術者は密な網を削除した。
为什么{C}的市场改进了第一份草稿？
因此，{C}的学校在春天替换了当地的记录。
{K}は短い答えを比べたが、{K}には{d4}個しかない。
{K}と{K}のあいだで、博物館は{d4}件の記録を残した。
We flew from {G} to {G} in {M}.
The {G} was built in {y} and restored in {y}.
{G} and {G} signed the treaty on {date}.
The {G} team beat {G} by {d2} to {d1}.
I read it in the {G} and on {G}.
Open {G} and click on Settings.
Professor of Physics at {G}, she won the {G} Prize.
Invoice {d6} of {M} {d2}, {y} came to ${d3}.{d2}.
The train to {G} leaves at {d1}:{d2} from platform {d1}.
Room {d3} on floor {d1} is free.
Chapter {d1} has {d2} pages and {d3} notes.
In {y}, about {d3},{d3} people lived in {G}.
The {G} Method and the {G} Theorem are different.
Thank You For Reading This Page.
Good Morning America was on again.
Happy New Year and Merry Christmas to all!
The United Nations met in {G} in {M}.
Monday, {M} {d1}, is a holiday in {G}.
Version {d1}.{d2} of {G} costs {d2} dollars.
The score was {d2}-{d2} after {d2} minutes.
Flight {F}{d3} from {G} is late.
Part number {F}-{d4} fits the {G} pump.
The bus stops at {G} Street and at the {G} Bridge.
My Favourite Film is an old one.
Notably, officials said that the {w} of {P} is late.
By comparison, officials added that {P} keeps {d4} {w}s.
For instance, a spokesperson added that the {w} limits {d4} {w}s.
Con mucho cuidado, el tribunal de {P} guarda los archivos.
Durante la siega, la aldea de {P} mejora el borrador.
Avec beaucoup de soin, la presse de {P} complète le rapport.
Der Zug nach {G} fährt um {d2}:{d2} Uhr.
Die Bundesrepublik Deutschland hat {d2} Nachbarn.
Im {MD} {y} war {G} sehr kalt.
Das Deutsche Museum in {G} ist groß.
Der Richter prüft den Antrag und der Fluss steigt.
Die Hochschule {G} hat {d2}.{d3} Studenten.
Der Vertrag von {G} gilt seit {y}.
Guten Morgen, liebe Gäste, und Frohe Weihnachten!
Die Firma {G} verkauft neue Geräte in {G}.
Das Haus kostet {d3}.{d3} Euro.
Le Musée de {G} ferme à {d2} heures.
Le Conseil d'État a rendu {d2} avis.
Le train pour {G} part à {d2}h{d2}.
La Tour Eiffel et le Palais Royal sont à Paris.
En {y}, {G} comptait {d3} {d3} habitants.
La société {G} vend des machines à {G}.
Bonjour tout le monde et Joyeux Noël !
El tren a {G} sale a las {d2}:{d2}.
La Universidad de {G} tiene {d3} alumnos.
En {y} vivían {d3}.{d3} personas en {G}.
El Museo del Prado abre a las {d2}.
El Gobierno de {G} publicó {d2} informes.
Buenos Aires y {G} son ciudades grandes.
La empresa {G} vende máquinas en {G}.
O comboio para {G} parte às {d2}:{d2}.
A Universidade de {G} tem {d3} alunos.
O Rio de Janeiro e {G} são cidades grandes.
A empresa {G} vende máquinas em {G}.
Поезд в {RG} уходит в {d2}:{d2}.
В {y} году в городе {RG} жило {d3} тысяч человек.
Компания {RG} продаёт машины.
Красная площадь и Московский Кремль открыты.
Добрый день и с Новым Годом!
去{CG}的火车{d2}点{d2}分开。
{CG}在{y}年有{d3}万人。
{CG}大学有{d4}名学生。
这家公司在{CG}卖机器。
我们去年参观了{CG}博物馆。
大家早上好，新年快乐！
今天天气很好，我们去公园。
{JG}行きの電車は{d2}時{d2}分に出ます。
{JG}大学には{d4}人の学生がいます。
{y}年に{JG}の博物館が開いた。
この会社は{JG}で機械を売っている。
おはようございます、よいお年を。
今日は天気がいいので公園に行きます。
{JG}は日本で有名な町です。
{JG}銀行が新しい店を開いた。
山の上に古い寺があります。
来年、新しい橋ができる。
{CG}银行开了新店。
山上有一座古庙。
明年会建一座新桥。
{X} {x} {x} {G} {x} {x}.
{X} {x} {G} {x} {x} {P}.
{X} {x} {x} {d3} {x} {x}.
{X} {x} {d4} {x}, {x} {G}.
{X} {P} {x} {x} {d2} {x}.
{XR} {xr} {RG} {xr} {xr}.
{XR} {xr} {xr} {d3} {xr}.
The {P} estimator and the {P} bound are both {w}s.
Весной {R} описывает длинный список.
Осенью {RG} закрывает старый завод.
Летом в {RG} тепло, а зимой {R} не меняется.
Банк {RG} открыл отделение.
В Средней Азии и в Верхней Волге сухо.
Театр {RG} закрыт до осени.
Ohne Vorwarnung erklärt {P} die neuen Regeln.
Außerdem verzögert {P} den Entwurf und der Verlag begrenzt mit großer Sorgfalt die Liste.
Das Alte Rathaus und das Neue Museum stehen in {G}.
Der Zweite Vertrag endete {y}.
Die Technische Hochschule {G} und die Stadt {G} bauen.
Unser Haus steht in {G}, unser Garten auch.
Im {MD} fielen {d2} Liter Regen.
Die Freie Stadt {G} liegt am Großen See.
À basse température, {P} ignore les valeurs.
Afterwards, each {w} of {P} holds {d4} {w}s.
Order {d4}-{d3}-{d4} and order {d3}-{d3}-{d4} were for the {w}.
Ping @{l} in the channel about ticket #{d3}-{d4} or #{d4}-{d4}.
La Casa Blanca y el Palacio Real son famosos.
El Museo de {G} y el Teatro Colón abren hoy.
El Banco de {G} cerró en {y}.
A Casa da Música e o Banco de {G} abrem hoje.
La Banque de {G} et le Théâtre Français ouvrent.
The Bank of {G} and the {G} Museum open today.
The Brooklyn Bridge and the Grand Canal are old.
See arXiv:{d4}.{d4} and doi {d2}.{d4}.
Em baixa temperatura, {P} limita as perguntas.
村民讨论了{CG}的新计划，尽管雨很大。
法院和学校都在{CG}。
"""
_NOUNS = "archive battery beam bridge cache census clinic cortex critic decoder draft driver engine error factory ferry filter forest graph harbour index kernel ledger lepton market matrix model orbit parser pilot polymer proof query recipe reader river sampler school sensor shelf storm survey tensor token treaty tumour user vector voter window witness".split()

_RU = "бел ва вы гас дук зим кря ла лен ло ми нар пет рен ске тор фол юла".split()
_RU_GIVEN = "Иван Ольга Павел Нина Илья Анна Мария Сергей Елена Олег Вера Дмитрий Алексей Наталья Андрей Ирина Татьяна Николай Владимир Юрий Светлана Михаил".split()
_RU_ENDS = "ов ова ин ина енко ский ев ева".split()
_ZH = "邬昀汀蓁琨褚麓岚垚骁栩钰漪畲颐隗衍谌晗黛鄢殷蔺笙苡柘珞霁甯"
_KANA = "バ ド フォ カ キ ラ ロ ミ ム ネ リ サ ソ タ ト ヴェ ユ ズ".split()


def _cyrillic(rng: random.Random, ends: list[str]) -> str:
    return ("".join(rng.choice(_RU) for _ in range(rng.randint(2, 3))) + rng.choice(ends)).capitalize()


def _of(rng: random.Random, letters: str, n: int) -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def _name_ru(rng: random.Random) -> str:
    last = rng.choice(_RU_LAST) + rng.choice(("", "", "а")) if rng.random() < 0.5 else _cyrillic(rng, _RU_ENDS)
    given = rng.choice(_RU_GIVEN)
    kind = rng.random()
    return f"{given[0]}. {given[1].upper()}. {last}" if kind < 0.1 else f"{given} {rng.choice(_RU_GIVEN)[:4]}ович {last}" if kind < 0.2 else f"{last} {given}" if kind < 0.28 else f"{given} {last}"


def _local(rng: random.Random, kind: str) -> str:
    """Names and addresses of scripts other than Latin."""
    kana = "".join(rng.choice(_KANA) for _ in range(3))
    n = rng.randint(1, 399)
    known = rng.random() < 0.5
    if kind == "name_ru":
        return _name_ru(rng)
    if kind == "address_ru":
        street = _cyrillic(rng, [""]) if rng.random() < 0.6 else rng.choice(("Ленина", "Пушкина", "Мира", "Гагарина", "Садовая", "Лесная"))
        return rng.choice((f"ул. {street}, д. {n}, кв. {rng.randint(1, 99)}", f"ул. {street}, д. {n}, кв. {rng.randint(1, 99)}", f"улица {street}, {n}", f"г. {rng.choice(RU_PLACES)}, ул. {street}, {n}", f"пр. {street}, д. {n}"))
    if kind == "name_zh":
        return rng.choice(FAMILY_NAMES) + _of(rng, _GIVEN_ZH, rng.choice((1, 2, 2, 2))) if known else rng.choice(FAMILY_NAMES + _ZH) + _of(rng, _ZH, rng.randint(1, 2))
    if kind == "address_zh":
        street = _of(rng, _ZH, rng.randint(2, 3)) if rng.random() < 0.6 else rng.choice(("中山", "人民", "解放", "建设", "南京", "长安", "和平", "新华"))
        town = rng.choice(("", "", "", rng.choice(ZH_PLACES) + "市", rng.choice(ZH_PLACES) + "市" + rng.choice(("朝阳", "海淀", "天河", "南山")) + "区"))
        return f"{town}{street}{rng.choice('路街')}{n}号" + rng.choice(("", "", f"{rng.randint(1, 30)}室"))
    if kind == "name_ja":
        return rng.choice(_JA_FAMILY) + (rng.choice((rng.choice(_JA_GIVEN), _of(rng, _JA_LETTERS, rng.choice((1, 2, 2))))) if known else kana)
    town = kana if rng.random() < 0.6 else rng.choice(JA_PLACES) + rng.choice("都府県市")
    return town + rng.choice("町市区") + rng.choice((f"{rng.randint(1, 9)}丁目{n}番地", f"{rng.randint(1, 9)}丁目{n}番地", f"{rng.randint(1, 9)}-{rng.randint(1, 30)}-{rng.randint(1, 30)}"))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng: random.Random, ends: list[str], least: int = 1, most: int = 2) -> str:
    return ("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(least, most))) + rng.choice(ends)).capitalize()


def _free_word(rng: random.Random) -> str:
    """A word of letters that no list and no syllable table holds."""
    return "".join(rng.choice("bcdfghjklmnprstvwz") * (rng.random() < 0.9) + rng.choice("aeiou") + rng.choice(("", "", "n", "r", "s", "k", "l", "h")) for _ in range(rng.randint(1, 3))).capitalize()


def _filler(rng: random.Random) -> str:
    """A word that tells nothing: an invented one, or a short common one of some language."""
    return rng.choice(_COMMON) if rng.random() < 0.45 else _free_word(rng).lower()


_COMMON = "the of in and to with from at for on by was is had de la le les et en un une por con el los y que da do os com para em der die das und mit von zu im ist hat wird not was who said".split()


def _name(rng: random.Random) -> str:
    style = rng.random()
    if style < 0.45:
        given, last = rng.choice(GIVEN), _word(rng, SURNAME_ENDS)
    elif style < 0.72:
        given, last = rng.choice(GIVEN), rng.choice(SURNAMES)
    elif style < 0.86:
        given, last = rng.choice((rng.choice(GIVEN), _free_word(rng))), _free_word(rng)
    else:
        given, last = _free_word(rng), rng.choice(SURNAMES)
    extra = rng.random()
    if extra < 0.14:
        last += "-" + (rng.choice(SURNAMES) if style > 0.45 else _word(rng, SURNAME_ENDS))
    elif style > 0.45 and extra < 0.24:
        last = rng.choice(("van ", "von ", "de ", "da ", "van der ", "de la ", "al-", "O'", "Mc", "bin ", "dos ")) + last
    elif style > 0.45 and extra < 0.34:
        given += rng.choice(("-", " ")) + rng.choice(GIVEN)
    kind = rng.random()
    full = f"{last}, {given}" if kind < 0.2 else f"{given} {rng.choice('ABCDEFGHIJKLMNOPRSTVW')}. {last}" if kind < 0.34 else f"{given[0]}. {last}" if kind < 0.37 and style > 0.45 else f"{given} {last}"
    return full.lower() if rng.random() < 0.16 and given in _LISTED else full


_LISTED = frozenset(GIVEN)


def _email(rng: random.Random) -> str:
    given, last = rng.choice(GIVEN).lower(), rng.choice((_word(rng, SURNAME_ENDS), _word(rng, SURNAME_ENDS), rng.choice(SURNAMES), _free_word(rng))).lower()
    given, last = (re.sub(r"[^a-z]", "", t) or "x" for t in (given, last))
    local = rng.choice((f"{given}.{last}", f"{given}_{last}", f"{given}-{last}", f"{given[0]}{last}{_digits(rng, 2)}", f"{last}+list", f"{given}{_digits(rng, 2)}", last, "info"))
    domain = rng.choice(("example.com", "example.org", "dept.uni.test", "mail.example.net", "post.invalid", f"{last}.example", "gmail.com", "web.de", f"{last}.co.uk", "mail.ru", f"{last}.fr"))
    if rng.random() < 0.15:
        local = local.upper()
    at = rng.choice(("@",) * 9 + ("&#64;", "＠", " @ ", " (at) ", " [at] ", " &#64; ", "%40", "&commat;"))
    dot = " [dot] " if "[" in at else " (dot) " if "(" in at and rng.random() < 0.4 else "&#46;" if rng.random() < 0.1 else "."
    return local.replace(".", "&#46;" if dot == "&#46;" else ".") + at + domain.replace(".", dot)


def _phone(rng: random.Random) -> str:
    area, last = rng.choice(("212", "306", "415", "617", "808")), f"01{_digits(rng, 2)}"
    d = lambda n: _digits(rng, n)
    if rng.random() < 0.6:
        return rng.choice((f"+1 {area} 555 {last}", f"+1{area}555{last}", f"({area}) 555-{last}", f"{area}.555.{last}", f"{area}-555-{last}", f"555-{last} ext. {d(2)}", f"555-{last} x{d(3)}", f"+44 7700 900 {d(3)}", f"07700 900{d(3)}", f"+33 1 99 00 {d(2)} {d(2)}", f"+49 30 23125 {d(3)}", f"030/23125{d(3)}"))
    country = rng.choice(("1", "7", "27", "33", "34", "39", "44", "49", "55", "81", "86", "91", "233", "351"))
    return rng.choice((f"+{country} {d(2)} {d(3)} {d(4)}", f"+{country} {d(3)} {d(3)} {d(3)}", f"+{country}{d(9)}", f"+{country} ({d(3)}) {d(3)}-{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(3)} {d(6)}", f"0{d(2)}-{d(4)}-{d(4)}", f"1{d(10)}", f"{d(3)}-{d(4)}", f"{d(7)}", f"{d(3)} {d(3)} {d(3)}", f"9{d(8)}", f"8 ({d(3)}) {d(3)}-{d(2)}-{d(2)}", f"({d(2)}) {d(5)}-{d(4)}", f"0{d(3)}/{d(6)}"))


def _id(rng: random.Random) -> str:
    d = lambda n: _digits(rng, n)
    up = lambda n: "".join(rng.choice("ABCDEFGHKLMNPRTXYZ") for _ in range(n))
    if rng.random() < 0.65:
        return rng.choice((f"9{d(2)}-00-{d(4)}", f"987-65-43{d(2)}", f"000 {d(2)} {d(4)}", f"C00X{d(5)}", f"X{d(7)}{rng.choice('ABQRTZ')}", f"{d(8)}-{rng.choice('ABHKZ')}", f"000000{d(11)}X", f"{d(3)}-{d(2)}-{d(4)}", f"ZZ {d(2)} {d(2)} {d(2)} {rng.choice('ABCD')}", f"{rng.choice('ABCGKLMN')}{d(8)}"))
    country = rng.choice(("DE", "FR", "ES", "PT", "GB", "NL", "IT"))
    return rng.choice((f"{up(2)}{d(7)}", f"{up(1)}{d(8)}", f"{d(9)}", f"{d(8)}{up(1)}", f"{d(2)}{up(2)}{d(5)}", f"{country}{d(20)}", f"{country}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(17)}X", f"{d(18)}", f"{d(4)} {d(6)}", f"{up(2)} {d(6)}"))


def _address(rng: random.Random, lang: str = "en") -> str:
    own = rng.random() < 0.6
    who, town = (_word(rng, SURNAME_ENDS), _word(rng, PLACE_ENDS)) if own else (rng.choice((rng.choice(SURNAMES), "Park", "Church", "Station", "High", _free_word(rng))), rng.choice((*[p for p in PLACES if " " not in p], _free_word(rng))))
    n, code = str(rng.randint(1, 1999 if rng.random() < 0.2 else 399)), _digits(rng, 5)
    if lang == "de":
        who = who if own else rng.choice((who, "Haupt", "Bahnhof", "Schul", "Garten", "Goethe"))
        return rng.choice((f"{who}straße {n}, {code} {town}", f"{who}platz {n}", f"Am {who}weg {n}a, {code} {town}", f"{who}gasse {n}, {code} {town}", f"{who}straße {n}", f"{who}str. {n}, {code} {town}", f"{who} Allee {n}, {code} {town}"))
    if lang == "fr":
        return rng.choice((f"{n} bis, avenue {who}, {code} {town}", f"{n} rue de {who}, {code} {town}", f"{n}, boulevard {who}, {code} {town}", f"{n} rue {who}, {code} {town}", f"{n}, rue de la {who}, {town}", f"{n} place {who}"))
    if lang in ("es", "pt"):
        streets = ("Calle", "Avenida", "Plaza", "Calle de", "Paseo de") if lang == "es" else ("Rua", "Avenida", "Travessa", "Rua da", "Praça")
        return rng.choice((f"{rng.choice(streets)} {who} {n}, {code} {town}", f"{rng.choice(streets)} {who}, {n}, 2º B, {code} {town}", f"{rng.choice(streets)} {who}, {n}, {code} {town}", f"{rng.choice(streets)} {who}, {n}, {town}", f"{rng.choice(streets)} {who} {n}"))
    kind = rng.choice(("Street", "St", "Street", "Road", "Rd", "Lane", "Avenue", "Ave.", "Drive", "Court"))
    return rng.choice((f"{n} {who} Street, {town}", f"{n} Old {who} Rd, {town}", f"Flat {rng.randint(1, 9)}, {n} {who} Lane, {town}", f"PO Box {n}, {town} {code}", f"{n} {who} Ave., Apt {rng.randint(1, 39)}, {town} {code}", f"{n} {who} {kind}", f"{n} {who} {kind}, {town}", f"{n} {who} {kind}, {town}, {rng.choice(('NY', 'CA', 'TX', 'OH', 'IL'))} {code}"))


def _fill(rng: random.Random, template: str) -> list[tuple[str, str | None]]:
    """Pieces of a filled sentence, each with its type or None."""
    out: list[tuple[str, str | None]] = []
    for part in re.split(r"(\[\w+\]|\{\w+\})", template):
        kind = part[1:-1]
        if part[:1] == "[" and kind:
            value = {"name": _name, "email": _email, "phone": _phone, "id": _id}.get(kind)
            text = value(rng) if value else _local(rng, kind) if kind[-2:] in ("ru", "zh", "ja") else _address(rng, kind[8:] or "en")
            label = {"id": "id_number"}.get(kind, kind.split("_")[0])
            wrap = rng.random()
            if label == "email" and wrap < 0.12 and " " not in text and "&" not in text:
                out += [('<a href="mailto:', None), (text, label), ('">', None), (text, label), ("</a>", None)]
            elif wrap < 0.16:
                out += [("<b>", None), (text, label), ("</b>", None)]
            else:
                out.append((text, label))
        elif part[:1] == "{":
            noun = rng.choice(_NOUNS)
            known = {
                "w": noun, "P": _word(rng, PLACE_ENDS), "Dp": "Anlage", "R": _cyrillic(rng, [""]), "C": _of(rng, _ZH, 3), "K": "".join(rng.choice(_KANA) for _ in range(3)), "l": _word(rng, PLACE_ENDS).lower(),
                "date": f"2023-0{_digits(rng, 1)}-1{_digits(rng, 1)}", "en": f"The {noun} of {_word(rng, PLACE_ENDS)} removes {_digits(rng, 4)} {rng.choice(_NOUNS)}s.", "y": str(rng.randint(1850, 2024)), "F": rng.choice("ABCLU") + rng.choice("AFHX"),
                "G": rng.choice((rng.choice(PLACES), rng.choice(PLACES), _word(rng, PLACE_ENDS), _free_word(rng))), "M": rng.choice(MONTHS), "MD": rng.choice(("Januar", "März", "Juli", "Oktober")), "x": _filler(rng), "X": _filler(rng).capitalize(), "xr": _cyrillic(rng, ["", "ет", "ый", "ом", "и"]).lower(), "XR": _cyrillic(rng, ["", "ет", "ый", "ом", "и"]),
                "RG": rng.choice(RU_PLACES), "CG": rng.choice(ZH_PLACES), "JG": rng.choice(JA_PLACES),
            }
            out.append((known.get(kind) or _digits(rng, int(kind[1:])), None))
        elif part:
            out.append((part, None))
    return out


def _script(t: str) -> str:
    return "ja" if re.search("[ぁ-ヿ]|{K}|{JG}|_ja", t) else "zh" if re.search("[㐀-鿿]", t) else "ru" if re.search("[а-я]", t) else "latin"


def labelled_table(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, marked spans): a few sentences in a row, plain or in markup."""
    rng = random.Random(seed)
    marked, plain = LABELLED.strip().split("\n"), PLAIN.strip().split("\n")
    of_script = {k: [t for t in plain if _script(t) == k] for k in map(_script, plain)}
    table = []
    for k in range(n):
        middle = marked[k % len(marked)] if k % 4 < 3 else plain[k // 4 % len(plain)]
        near = of_script[_script(middle)] if rng.random() < 0.8 else plain
        chosen = [rng.choice(near) for _ in range(rng.randint(0, 1))] + [middle] + [rng.choice(near if rng.random() < 0.85 else marked) for _ in range(rng.randint(0, 1))]
        before, after = rng.choice((("", " "),) * 5 + (("", "\n"), ("<p>", "</p>"), ("<li>", "</li>"), ("", "<br/>")))
        text, spans = "", []
        for c in chosen:
            text += before
            for piece, label in _fill(rng, c):
                if label:
                    spans.append((len(text), len(text) + len(piece), label))
                text += piece
            text += after
        table.append((text, spans))
    return table
