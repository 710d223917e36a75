"""Pages labelled by hand: blocks of the article stand in elements with ``data-label="main"``.

They show what the sampled pages of a crawl may lack: side bars, notices, forms,
comments, related links, pages without ``<article>``. Fixed values.
"""

from __future__ import annotations

_M = 'data-label="main"'
_LONG = "The council met on Tuesday evening to discuss the new bridge, which has been delayed for more than two years because of rising costs and a dispute over land."
_MORE = "Engineers said that the foundations are sound. They expect the work to take eighteen months, and promised to keep one lane open for cyclists throughout."
_LAST = "A final vote is planned for the end of the month."
_COMMENT = "I have lived next to the old bridge for thirty years and I can only say that nobody has ever asked us what we think about any of this."
_REPLY = "Well said, and thanks for sharing your view with all of us here."
_COOKIE = "We use cookies to improve your experience on this site and to show you relevant advertising. By continuing you agree to our use of cookies."
_SIGNUP = "Sign up for our weekly newsletter and never miss a story from our reporters around the region."
_AD = "Save up to 50 percent on garden furniture this week only. Order now and get free delivery to your door."
_DE = [
    "Neue Brücke über den Fluss",
    "Der Stadtrat hat am Dienstagabend über den Bau der neuen Brücke beraten, der sich wegen steigender Kosten um mehr als zwei Jahre verzögert hat.",
    "Die Fachleute halten die alten Pfeiler für sicher und rechnen mit achtzehn Monaten Bauzeit, in denen eine Spur für Fahrräder offen bleibt.",
    "Die Kosten trägt zur Hälfte das Land.",
    "Den Rest zahlt die Stadt aus ihren Rücklagen.",
    "Am Ende des Monats wird abgestimmt.",
]
_FR = [
    "Un nouveau pont sur la rivière",
    "Le conseil municipal s'est réuni mardi soir pour parler du nouveau pont, dont la construction a pris plus de deux ans de retard à cause des coûts.",
    "Selon les ingénieurs, les fondations sont solides et les travaux devraient durer dix-huit mois, avec une voie ouverte aux cyclistes.",
    "Un vote est prévu à la fin du mois.",
]
_ES = [
    "Un nuevo puente sobre el río",
    "El ayuntamiento se reunió el martes por la noche para hablar del nuevo puente, que lleva más de dos años de retraso por el aumento de los costes.",
    "Los ingenieros dicen que los cimientos son firmes y que las obras durarán dieciocho meses, con un carril abierto para bicicletas.",
    "La votación será a finales de mes.",
]
_TECH = [
    "A file is opened with its name and read line by line, so that a large file never has to fit into memory as a whole.",
    "The block closes the file when it ends, even if something goes wrong on the way.",
    "Choose an encoding if the text is not plain English.",
    "Check that the file exists before you read it.",
]

PAGES = [
    f"""<html><body><header><h1>Daily Post</h1><nav><a href=/>Home</a> <a href=/s>Sport</a></nav></header><main {_M}><h1>New bridge</h1><p>{_LONG}</p><p>{_MORE}</p><p>{_LAST}</p></main>
    <aside><h2>Most read</h2><ul><li><a href=1>Storm warning for the coast</a></li><li><a href=2>Ten tips for spring</a></li></ul></aside><footer><p>© 2020 Daily Post. All rights reserved.</p></footer></body></html>""",
    f"""<body><div id="cookie-notice"><p>{_COOKIE}</p><button>Accept</button></div><div class="topbar"><a href=a>Login</a></div><div id="content"><div class="post" {_M}><h2>Bridge delayed</h2><p>{_MORE}</p><p>{_LONG}</p></div>
    <div class="comments"><h3>Comments</h3><div class="comment"><p>{_COMMENT}</p></div><div class="comment reply"><p>{_REPLY}</p></div></div></div><div id="sidebar"><p>{_SIGNUP}</p><form><input><button>Go</button></form></div><div id="footer">Copyright Post Ltd</div></body>""",
    f"""<body><div class="menu"><ul><li><a href=a>News</a></li><li><a href=b>Weather</a></li><li><a href=c>Contact</a></li></ul></div><div class="ad"><p>{_AD}</p></div><div class="story" {_M}><h1>Vote on the bridge</h1><p>{_LONG}</p><ul><li>{_MORE}</li><li>{_LAST}</li></ul></div>
    <div class="related"><h3>Related stories</h3><p><a href=x>How the old bridge was built</a></p></div><section id="comments"><p>{_COMMENT}</p><p>{_REPLY}</p></section><p class="copyright">&copy; The Post</p></body>""",
    f"""<body><nav><ol><li><a href=a>Start</a></li><li><a href=b>Archive</a></li></ol></nav><article><header><h1 {_M}>Bridge plans</h1><p class="byline">By A. Writer, 3 May</p></header><div {_M}><p>{_LONG}</p><blockquote>{_LAST}</blockquote><p>{_MORE}</p></div><aside class="promo"><p>{_AD}</p></aside><footer>Tags: <a href=t>bridge</a></footer></article>
    <form action=/c><label>Your comment</label><p>{_SIGNUP}</p></form><footer><p>Contact us at the address below. All rights reserved.</p></footer></body>""",
    f"""<body><div class="header"><p>Welcome to our forum. Please read the rules before you post anything.</p></div><table><tr><td class="nav"><a href=1>One</a><br><a href=2>Two</a></td><td {_M}><p>{_LONG}</p><p>{_MORE}</p></td><td class="sidebar"><p>{_SIGNUP}</p><p>{_AD}</p></td></tr></table><div class="footer"><a href=i>Imprint</a> <a href=p>Privacy</a></div></body>""",
    f"""<body><header><p>{_SIGNUP}</p></header><div role="navigation"><a href=a>A</a><a href=b>B</a></div><div class="notice"><p>{_COOKIE}</p></div><div class="entry-content" {_M}><p>{_MORE}</p><p>{_LAST}</p><p>{_LONG}</p><p>Yes.</p></div><div class="share"><a href=f>Share this</a></div><div id="disqus_thread"><article class="comment"><p>{_COMMENT}</p></article><article class="comment"><p>{_REPLY}</p></article></div><footer>{_AD}</footer></body>""",
    f"""<body><article><h1 {_M}>Works begin</h1><p {_M}>{_LONG}</p><div class="ad"><p>{_AD}</p></div><p {_M}>{_MORE}</p><div class="newsletter"><p>{_SIGNUP}</p></div><p {_M}>{_LAST}</p><section class="comments"><h2>3 comments</h2><p>{_COMMENT}</p><p>{_REPLY}</p></section></article><aside><p>{_LONG}</p></aside></body>""",
    f"""<body><nav><a href=a>Home</a></nav><aside class="sidebar"><h2>About</h2><p>{_COMMENT}</p><p>{_LAST}</p></aside><article {_M}><h1>Short note</h1><p>{_LAST}</p></article><form class="search"><p>Search our archive of more than ten thousand stories.</p><input><button>Search</button></form><div class="comments"><p>{_REPLY}</p></div><footer><p>{_AD}</p></footer></body>""",
    f"""<body><div class="login"><form><p>Please log in to continue reading this and other stories.</p><input></form></div><div class="page"><div class="main" {_M}><p>{_LONG}</p><p>{_LONG}</p><h2>What comes next</h2><p>{_MORE}</p></div><div class="banner">{_AD}</div><div class="pagination"><a href=1>1</a> <a href=2>2</a></div></div><div class="cookie"><p>{_COOKIE}</p></div></body>""",
    f"""<body><header class="masthead"><p>{_AD}</p></header><div class="notice"><p>{_SIGNUP}</p></div><nav><p>{_REPLY}</p></nav><form><p>{_COOKIE}</p></form></body>""",
    f"""<body><nav><a href=a>News</a></nav><article {_M}><h1>Reader's guide</h1><p>{_MORE}</p><pre>a = 1</pre><table><tr><th>Year</th><td>1998</td></tr></table><p>{_LAST}</p></article><div class="comment-list"><ul><li><p>{_COMMENT}</p></li><li><p>{_LONG}</p></li></ul></div><aside><p>{_MORE}</p></aside><footer>{_LAST}</footer></body>""",
    # Pages that name nothing: only structure and text tell.
    f"""<html><head><title>x</title><body><div><a href=/>Start</a> <a href=/n>Nachrichten</a> <a href=/k>Kontakt</a></div><div><div {_M}><h1>{_DE[0]}</h1><p>{_DE[1]}</p><p>{_DE[2]}</p><ul><li>{_DE[3]}</li><li>{_DE[4]}</li></ul><p>{_DE[5]}</p></div>
    <div><div><a href=1>Mehr lesen</a></div><div><a href=2>Wetter</a></div></div></div><div><p>© 2021 Der Bote</p></div></body></html>""",
    f"""<body><div><ul><li><a href=a>Accueil</a></li><li><a href=b>Sport</a></li><li><a href=c>Culture</a></li></ul></div><div {_M}><h2>{_FR[0]}</h2><div>{_FR[1]}</div><div>{_FR[2]}</div><table><tr><th>Ville</th><th>Habitants</th></tr><tr><td>Lyon</td><td>522 969</td></tr><tr><td>Lille</td><td>236 234</td></tr></table><div>{_FR[3]}</div></div>
    <div><a href=m>Mentions légales</a> <a href=p>Plan du site</a></div></body>""",
    f"""<body><table><tr><td><a href=1>Inicio</a><br><a href=2>Noticias</a><br><a href=3>Contacto</a></td><td {_M}><h1>{_ES[0]}</h1><p>{_ES[1]}</p><p>{_ES[2]}</p><blockquote>{_ES[3]}</blockquote></td></tr></table><p><a href=x>Aviso legal</a></p></body>""",
    f"""<body><div><div><a href=a>Docs</a></div><div><a href=b>Blog</a></div></div><div {_M}><h1>Reading a file</h1><p>{_TECH[0]}</p><pre>with open(name) as f:\n    print(f.read())</pre><p>{_TECH[1]}</p><ol><li>{_TECH[2]}</li><li>{_TECH[3]}</li></ol><p>Done.</p></div><div>© Example Docs. All rights reserved.</div></body>""",
    f"""<body><div {_M}><p>{_LONG}</p><p>{_MORE}</p><p>{_LAST}</p></div></body>""",
    f"""<body><div><div><div><a href=q>Top</a></div></div><div><div {_M}><div><p>{_FR[2]}</p></div><div><p>{_FR[1]}</p><dl><dt>Pont</dt><dd>{_FR[3]}</dd></dl></div></div></div></div><div><form><p>{_SIGNUP}</p><input><button>Go</button></form></div></body>""",
]
