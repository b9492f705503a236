"""Pages written by hand after the markup of common publishing systems, with the main text that a reader would name."""

from __future__ import annotations

WIKI = (
    """<!DOCTYPE html><html class="client-nojs" lang="en"><head><meta charset="UTF-8"><title>Barn owl - Freepedia</title><script>document.documentElement.className="client-js";</script>
<link rel="stylesheet" href="/load.css"></head><body class="mediawiki ltr sitedir-ltr ns-0 page-Barn_owl skin-vector">
<a class="mw-jump-link" href="#bodyContent">Jump to content</a><div class="vector-header-container"><header class="vector-header mw-header"><div class="vector-header-start"><nav class="vector-main-menu-landmark" aria-label="Site">
<ul class="vector-menu-content-list"><li id="n-mainpage" class="mw-list-item"><a href="/wiki/Main_Page"><span>Main page</span></a></li><li id="n-contents" class="mw-list-item"><a href="/wiki/Contents"><span>Contents</span></a></li><li><a href="/wiki/Random"><span>Random article</span></a></li></ul></nav></div>
<div id="p-search" role="search"><form action="/w/index.php" id="searchform" class="cdx-search-input"><input type="search" name="search" placeholder="Search Freepedia"><button>Search</button></form></div></header></div>
<div class="mw-page-container"><div class="mw-content-container"><main id="content" class="mw-body"><header class="mw-body-header"><h1 id="firstHeading" class="firstHeading mw-first-heading"><span class="mw-page-title-main">Barn owl</span></h1></header>
<div id="bodyContent" class="vector-body"><div id="mw-content-text" class="mw-body-content"><div class="mw-content-ltr mw-parser-output">
<p>The <b>barn owl</b> is the most widely distributed species of <a href="/wiki/Owl">owl</a> in the world, and one of the most widespread of all birds.<sup class="reference"><a href="#cite_note-1">[1]</a></sup> It is found almost everywhere but in polar and desert regions.</p>
<div class="mw-heading mw-heading2"><h2 id="Description">Description</h2></div>
<p>The ground colour of the plumage varies; the face has a heart shape, and the call is a shrill scream. Adults weigh between 250 and 480&nbsp;grams.</p>
<ul><li>Wings are long and rounded.</li><li>The tail is short, with dark bars.</li></ul>
<div class="mw-heading mw-heading2"><h2 id="Behaviour">Behaviour</h2></div>
<p>Like most owls it is active at night, hunting mostly by sound over open ground. Pairs stay together as long as both live.</p>
</div></div></div></main></div>
<div class="mw-footer-container"><footer id="footer" class="mw-footer"><ul id="footer-info"><li id="footer-info-lastmod">This page was last edited on 3 May 2024, at 11:02.</li><li id="footer-info-copyright">Text is available under a free licence; additional terms may apply.</li></ul><ul id="footer-places"><li><a href="/privacy">Privacy policy</a></li><li><a href="/about">About</a></li></ul></footer></div></div></body></html>""",
    "Barn owl The barn owl is the most widely distributed species of owl in the world, and one of the most widespread of all birds.[1] It is found almost everywhere but in polar and desert regions. Description The ground colour of the plumage varies; the face has a heart shape, and the call is a shrill scream. Adults weigh between 250 and 480 grams. Wings are long and rounded. The tail is short, with dark bars. Behaviour Like most owls it is active at night, hunting mostly by sound over open ground. Pairs stay together as long as both live.",
)

BLOG = (
    """<!DOCTYPE html><html lang="en-US"><head><title>Baking with rye &#8211; A small kitchen</title><style>.has-text{color:red}</style></head>
<body class="post-template-default single single-post postid-112 wp-embed-responsive"><div id="page" class="hfeed site"><a class="skip-link screen-reader-text" href="#content">Skip to content</a>
<header id="masthead" class="site-header" role="banner"><div class="site-branding"><p class="site-title"><a href="/" rel="home">A small kitchen</a></p><p class="site-description">Bread, soup and other plain things</p></div>
<nav id="site-navigation" class="main-navigation" role="navigation"><div class="menu-main-container"><ul id="primary-menu" class="menu"><li class="menu-item"><a href="/about/">About</a></li><li class="menu-item"><a href="/recipes/">Recipes</a></li><li class="menu-item"><a href="/contact/">Contact</a></li></ul></div></nav></header>
<div id="content" class="site-content"><div id="primary" class="content-area"><main id="main" class="site-main" role="main"><article id="post-112" class="post-112 post type-post status-publish format-standard hentry category-bread"><header class="entry-header"><h1 class="entry-title">Baking with rye</h1></header>
<div class="entry-content"><p>Rye flour has little gluten, so the dough never gets stretchy. That is no fault of yours; wet hands and a tin help.</p>
<h3 class="wp-block-heading">What you need</h3><ul class="wp-block-list"><li>400 g rye flour</li><li>300 ml warm water</li><li>a cup of sourdough starter</li></ul>
<p>Mix everything, cover the bowl, and wait until the top cracks. In my cold kitchen that takes about six hours, in summer three.</p><blockquote class="wp-block-quote"><p>Bread is patience that you can eat, as my grandmother said.</p></blockquote><p>Bake for an hour, and do not cut the loaf before the next day.</p></div></article>
<nav class="navigation post-navigation" aria-label="Posts"><div class="nav-links"><div class="nav-previous"><a href="/soup/" rel="prev">Onion soup</a></div><div class="nav-next"><a href="/buns/" rel="next">Cinnamon buns</a></div></div></nav>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on &ldquo;Baking with rye&rdquo;</h2><ol class="comment-list"><li id="comment-9" class="comment even thread-even depth-1"><article class="comment-body"><footer class="comment-meta"><b class="fn">Ines</b> says:</footer><div class="comment-content"><p>Mine never cracked, but it tasted fine in the end, thank you for this!</p></div></article></li><li class="comment odd"><article class="comment-body"><div class="comment-content"><p>Could I use spelt instead of rye here, or would that be too soft?</p></div></article></li></ol>
<div id="respond" class="comment-respond"><h3 id="reply-title">Leave a Reply</h3><form id="commentform"><p class="comment-notes">Your email address will not be published. Required fields are marked *</p><textarea name="comment"></textarea></form></div></div></main></div>
<aside id="secondary" class="widget-area" role="complementary"><section id="recent-posts-2" class="widget widget_recent_entries"><h2 class="widget-title">Recent Posts</h2><ul><li><a href="/soup/">Onion soup</a></li><li><a href="/beans/">Beans for a week</a></li></ul></section><section class="widget widget_text"><p>Hello! I bake on weekends and write about it here when there is time.</p></section></aside></div>
<footer id="colophon" class="site-footer" role="contentinfo"><div class="site-info"><a href="https://example.org/">Proudly powered by a publishing system</a></div></footer></div></body></html>""",
    "Baking with rye Rye flour has little gluten, so the dough never gets stretchy. That is no fault of yours; wet hands and a tin help. What you need 400 g rye flour 300 ml warm water a cup of sourdough starter Mix everything, cover the bowl, and wait until the top cracks. In my cold kitchen that takes about six hours, in summer three. Bread is patience that you can eat, as my grandmother said. Bake for an hour, and do not cut the loaf before the next day.",
)

NEWS = (
    """<!doctype html><html lang="de"><head><title>Neue Brücke eröffnet | Tageblatt</title></head><body>
<div class="cookie-banner" id="cmp"><p>Wir verwenden Cookies, um Inhalte zu personalisieren und Zugriffe zu messen. Mit einem Klick stimmen Sie zu.</p><button>Alle akzeptieren</button><button>Einstellungen</button></div>
<div class="page-wrapper"><header class="page-header"><a href="/" class="logo">Tageblatt</a><div class="header-date">Montag, 3. Juni 2024</div><nav class="ressorts"><a href="/politik">Politik</a><a href="/wirtschaft">Wirtschaft</a><a href="/sport">Sport</a><a href="/kultur">Kultur</a></nav></header>
<div class="ad-slot ad-slot--billboard"><span class="ad-label">Anzeige</span><p>Jetzt drei Monate lesen und nur einen bezahlen.</p></div>
<div class="layout"><article class="story" itemscope itemtype="http://schema.org/NewsArticle"><span class="story-kicker">Verkehr</span><h1 itemprop="headline" class="story-title">Neue Brücke nach fünf Jahren eröffnet</h1><p class="story-lead">Die Stadt hat am Sonntag die neue Brücke über den Fluss für den Verkehr freigegeben. Tausende kamen zum Fest.</p>
<figure class="story-image"><img src="a.jpg" alt="x"><figcaption>Die Brücke am Morgen der Eröffnung.</figcaption></figure>
<div class="story-text" itemprop="articleBody"><p>Der Bau hatte sich mehrmals verzögert, zuletzt wegen eines Fehlers in den Plänen. Am Ende kostete er 48 Millionen Euro.</p><p>„Wir sind froh, dass es vorbei ist“, sagte die Bürgermeisterin.</p>
<div class="ad-slot ad-slot--inline"><span>Anzeige</span><p>Günstige Reifen für jedes Auto, heute bestellt und morgen montiert.</p></div>
<p>Ab Montag fahren auch Busse über die Brücke, zunächst alle zwanzig Minuten.</p></div></article>
<aside class="sidebar"><section class="most-read"><h3>Meistgelesen</h3><ol><li><a href="/1">Regen am Wochenende</a></li><li><a href="/2">Markt zieht um</a></li></ol></section><section class="newsletter-box"><h3>Newsletter</h3><p>Jeden Morgen das Wichtigste in Ihrem Postfach, kostenlos und kündbar.</p><form><input type="email"><button>Anmelden</button></form></section></aside></div>
<section class="related-articles"><h2>Mehr zum Thema</h2><div class="teaser"><a href="/3"><h3>Warum der Bau so lange dauerte</h3><p>Ein Rückblick auf fünf Jahre voller Pannen und neuer Termine.</p></a></div></section>
<footer class="page-footer"><ul><li><a href="/impressum">Impressum</a></li><li><a href="/datenschutz">Datenschutz</a></li></ul><p>© 2024 Tageblatt Verlag. Alle Rechte vorbehalten.</p></footer></div><script>track("view");</script></body></html>""",
    "Verkehr Neue Brücke nach fünf Jahren eröffnet Die Stadt hat am Sonntag die neue Brücke über den Fluss für den Verkehr freigegeben. Tausende kamen zum Fest. Die Brücke am Morgen der Eröffnung. Der Bau hatte sich mehrmals verzögert, zuletzt wegen eines Fehlers in den Plänen. Am Ende kostete er 48 Millionen Euro. „Wir sind froh, dass es vorbei ist“, sagte die Bürgermeisterin. Ab Montag fahren auch Busse über die Brücke, zunächst alle zwanzig Minuten.",
)

MANUAL = (
    """<!DOCTYPE html><html><head><title>Pools &#8212; ropelib 2.1 documentation</title></head><body class="wy-body-for-nav"><div class="wy-grid-for-nav"><nav data-toggle="wy-nav-shift" class="wy-nav-side"><div class="wy-side-scroll"><div class="wy-side-nav-search"><a href="index.html" class="icon icon-home">ropelib</a><div role="search"><form id="rtd-search-form"><input type="text" placeholder="Search docs"></form></div></div><div class="wy-menu wy-menu-vertical" role="navigation"><ul><li class="toctree-l1"><a class="reference internal" href="start.html">Getting started</a></li><li class="toctree-l1 current"><a class="current reference internal" href="#">Pools</a></li></ul></div></div></nav>
<section class="wy-nav-content-wrap"><nav class="wy-nav-top"><a href="index.html">ropelib</a></nav><div class="wy-nav-content"><div class="rst-content"><div role="navigation" aria-label="Page navigation"><ul class="wy-breadcrumbs"><li><a href="index.html" class="icon icon-home"></a></li><li class="breadcrumb-item active">Pools</li><li class="wy-breadcrumbs-aside"><a href="_sources/pools.rst.txt" rel="nofollow"> View page source</a></li></ul><hr></div>
<div role="main" class="document" itemscope="itemscope"><div itemprop="articleBody"><section id="pools"><h1>Pools<a class="headerlink" href="#pools" title="Link to this heading"></a></h1><p>A pool keeps connections open and hands them out one at a time. Create it once and share it between threads.</p><div class="highlight-python notranslate"><div class="highlight"><pre>pool = Pool(size=4)
with pool.take() as c:
    c.send("hello")</pre></div></div><p>If all connections are taken, <code class="docutils literal">take()</code> waits until one comes back.</p><div class="admonition note"><p class="admonition-title">Note</p><p>A pool must be closed before the program ends, or its threads keep running.</p></div></section></div></div>
<footer><div class="rst-footer-buttons" role="navigation"><a href="start.html" class="btn btn-neutral">Previous</a><a href="errors.html" class="btn btn-neutral">Next</a></div><hr><div role="contentinfo"><p>&#169; Copyright 2023, The ropelib people.</p></div>Built with a generator using a theme.</footer></div></div></section></div></body></html>""",
    'Pools A pool keeps connections open and hands them out one at a time. Create it once and share it between threads. pool = Pool(size=4) with pool.take() as c: c.send("hello") If all connections are taken, take() waits until one comes back. Note A pool must be closed before the program ends, or its threads keep running.',
)

OLD = (
    """<HTML><HEAD><TITLE>The history of our mill</TITLE></HEAD><BODY BGCOLOR="#FFFFFF"><TABLE WIDTH=760 BORDER=0><TR><TD COLSPAN=2 CLASS="header"><IMG SRC="mill.gif"><FONT SIZE=+2>Mill Society</FONT></TD></TR>
<TR><TD WIDTH=150 VALIGN=TOP CLASS="menu"><A HREF="index.html">Home</A><BR><A HREF="history.html">History</A><BR><A HREF="visit.html">Visit us</A><BR><A HREF="links.html">Links</A></TD>
<TD VALIGN=TOP CLASS="content"><H1>The history of our mill</H1><P>The mill was built in 1742 by two brothers who had come from the coast. For a hundred years it ground the corn of nine villages.
<P>In 1861 a fire destroyed the roof, and the wheel stood still until a farmer bought the ruin. He repaired it with his sons.
<P>Since 1978 our society has looked after the building, which you can visit on Sundays.</TD></TR>
<TR><TD COLSPAN=2 ALIGN=CENTER CLASS="footer"><HR><FONT SIZE=-1>Last updated 12 March 2001. Mail the <A HREF="mailto:x">webmaster</A>. Copyright Mill Society.</FONT></TD></TR></TABLE></BODY></HTML>""",
    "The history of our mill The mill was built in 1742 by two brothers who had come from the coast. For a hundred years it ground the corn of nine villages. In 1861 a fire destroyed the roof, and the wheel stood still until a farmer bought the ruin. He repaired it with his sons. Since 1978 our society has looked after the building, which you can visit on Sundays.",
)

GEOMETRY = (
    """<html><body><div id="header"><h1><a href="/">Math notes</a></h1><ul class="nav"><li><a href="/a">Algebra</a></li><li><a href="/g">Geometry</a></li></ul></div>
<div id="content"><div class="post"><h2 class="post-title">Right triangles</h2><div class="post-body"><p>In a right triangle the sides satisfy <math><msup><mi>a</mi><mn>2</mn></msup><mo>+</mo><msup><mi>b</mi><mn>2</mn></msup><mo>=</mo><msup><mi>c</mi><mn>2</mn></msup></math>, where c is the longest.</p>
<p>Watch the proof: <video controls src="proof.mp4">Your browser does not play videos.</video> it takes two minutes.</p><audio src="proof.mp3"><p>The converse holds as well, which is proved in the next note.</p></div></div></div>
<div id="sidebar"><h3>Archive</h3><ul><li><a href="/2020">2020</a></li><li><a href="/2021">2021</a></li></ul></div><div id="footer"><p>All notes may be copied, with the name of their author.</p></div></body></html>""",
    "Right triangles In a right triangle the sides satisfy a2+b2=c2, where c is the longest. Watch the proof: it takes two minutes. The converse holds as well, which is proved in the next note.",
)

PAGES = {"wiki": WIKI, "blog": BLOG, "news": NEWS, "manual": MANUAL, "old": OLD, "geometry": GEOMETRY}

# written after the made layouts were final

FORUM = (
    """<!DOCTYPE html><html itemscope itemtype="https://schema.org/QAPage" class="html__responsive"><head><title>linux - How do I find large files? - Server Answers</title></head><body class="question-page unified-theme">
<div id="notify-container"></div><header class="s-topbar ps-fixed t0 l0 js-top-bar"><div class="s-topbar--container"><a href="#" class="s-topbar--menu-btn js-left-sidebar-toggle"><span></span></a><a href="https://x" class="s-topbar--logo js-gps-track"><span class="-img _glyph">Server Answers</span></a><ol class="s-navigation"><li><a href="/about" class="s-navigation--item">About</a></li></ol><form id="search" role="search" class="s-topbar--searchbar js-searchbar"><input name="q" type="text" placeholder="Search…"></form></div></header>
<div class="container"><div id="left-sidebar" class="left-sidebar js-pinned-left-sidebar ps-relative"><nav role="navigation"><ol class="nav-links"><li><a href="/" class="nav-links--link">Home</a></li><li><a href="/questions" class="nav-links--link">Questions</a></li><li><a href="/tags" class="nav-links--link">Tags</a></li></ol></nav></div>
<div id="content" class="snippet-hidden"><div itemprop="mainEntity" itemscope><div id="question-header" class="d-flex sm:fd-column"><h1 itemprop="name" class="fs-headline1 ow-break-word mb8 flex--item fl1"><a href="/q/1" class="question-hyperlink">How do I find large files?</a></h1></div>
<div id="mainbar" role="main" aria-label="question and answers"><div class="question js-question" id="question"><div class="post-layout"><div class="postcell post-layout--right"><div class="s-prose js-post-body" itemprop="text"><p>My disk is nearly full, and I would like to know which files take the most space. The server has no graphical tools.</p><p>I tried <code>ls -l</code>, but that shows one directory at a time only.</p></div></div></div></div></div></div></div></div>
<footer id="footer" class="site-footer js-footer" role="contentinfo"><div class="site-footer--container"><nav class="site-footer--nav"><div class="site-footer--col"><h5 class="-title"><a href="/x">Server Answers</a></h5><ul class="-list js-primary-footer-links"><li class="-item"><a href="/tour" class="-link">Tour</a></li><li class="-item"><a href="/help" class="-link">Help</a></li></ul></div></nav><div class="site-footer--copyright fs-fine"><p class="md:mb0">Site design / logo © 2024; user contributions licensed under a free licence.</p></div></div></footer></body></html>""",
    "How do I find large files? My disk is nearly full, and I would like to know which files take the most space. The server has no graphical tools. I tried ls -l, but that shows one directory at a time only.",
)
PRESS = (
    """<!DOCTYPE html><html lang="fr"><head><title>Communiqué</title></head><body><nav class="skip"><ul><li><a href="#c">Aller au contenu</a></li></ul></nav><div class="banner" role="banner"><div class="banner__inner"><p class="banner__name">Ministère des Eaux</p></div></div><div class="menu-bar"><ul><li><a href="/a">Le ministère</a></li><li><a href="/b">Actualités</a></li><li><a href="/c">Services</a></li></ul></div><div class="breadcrumb"><a href="/">Accueil</a> &gt; <a href="/b">Actualités</a> &gt; Communiqué</div>
<div id="c" class="grid"><div class="grid__main"><h1>Un plan pour les rivières</h1><p class="date">Publié le 4 mars 2024</p><p class="chapo">Le gouvernement présente un plan de cinq ans pour la qualité des rivières, avec les régions et les communes.</p><h2>Trois mesures</h2><ol><li>Des contrôles plus fréquents des rejets.</li><li>Une aide aux petites stations d'épuration.</li><li>Un suivi public, mis à jour chaque mois.</li></ol><p>Le ministre a remercié les associations qui ont participé à la préparation du texte.</p><div class="share"><p>Partager cette page</p><ul><li><a href="x">Courriel</a></li><li><a href="y">Réseaux</a></li></ul></div></div>
<div class="grid__side"><div class="box box--contact"><h3>Contact presse</h3><p>Service de presse, du lundi au vendredi, de 9 h à 18 h.</p></div></div></div><div class="footer"><p>Mentions légales - Accessibilité : partiellement conforme - Plan du site</p></div></body></html>""",
    "Un plan pour les rivières Publié le 4 mars 2024 Le gouvernement présente un plan de cinq ans pour la qualité des rivières, avec les régions et les communes. Trois mesures Des contrôles plus fréquents des rejets. Une aide aux petites stations d'épuration. Un suivi public, mis à jour chaque mois. Le ministre a remercié les associations qui ont participé à la préparation du texte.",
)
SHOP = (
    """<html><body><div class="topbar"><p>Free delivery from 50 euros, every day of the week.</p></div><header class="shop-header"><a href="/" class="shop-logo">Tea &amp; Pots</a><nav><a href="/tea">Tea</a> <a href="/pots">Pots</a> <a href="/cart">Cart (0)</a></nav></header><main><section class="product"><div class="product__info"><h1 class="product__title">Green tea from the hills</h1><p class="product__text">A light tea with a taste of fresh grass, picked in April and dried on the same day. It is packed by hand in small tins.</p><h2>How to make it</h2><p>Take water of 75 degrees and wait for two minutes. The leaves can be used three times.</p></div><form class="product__order"><label>Amount <select><option>100 g</option><option>250 g</option></select></label><button>Add to cart</button></form></section>
<section class="product-recommendations"><h2>You may also like</h2><ul><li><a href="/1">Black tea</a></li><li><a href="/2">Iron pot</a></li></ul></section><section class="reviews"><h2>Reviews</h2><div class="review"><p>Best tea I have had in years, I will order it again soon.</p></div></section></main><footer><div class="newsletter"><p>Sign up for our letter and get five percent off your first order.</p></div><p>© Tea &amp; Pots</p></footer></body></html>""",
    "Green tea from the hills A light tea with a taste of fresh grass, picked in April and dried on the same day. It is packed by hand in small tins. How to make it Take water of 75 degrees and wait for two minutes. The leaves can be used three times.",
)
HELD_OUT = {"forum": FORUM, "press": PRESS, "shop": SHOP}
