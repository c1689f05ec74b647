"""Pages written by hand with the text that a reader would call the article; none comes from the generator."""

PAGES = [
    (
        """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>River levels fall | The Valley Post</title>
<link rel="stylesheet" href="/s.css"><script>window.data = {"a": "<p>no</p>"};</script></head><body class="single">
<a class="skip-link" href="#main">Skip to content</a>
<header class="site-header"><div class="logo"><a href="/">The Valley Post</a></div>
<nav aria-label="Main"><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather</a></li></ul></nav></header>
<main id="main"><article class="story"><h1>River levels fall after dry spring</h1>
<p>The river has dropped by almost a metre since March, the water board said on Tuesday, and two ferries have stopped running.</p>
<p>Farmers along the lower valley were told to expect limits on pumping before the end of the month. Fields near the weir are already dry.</p>
<h2>What happens next</h2>
<p>Engineers will open the upper gates for three nights. If that does not help, the board will ask for water from the northern lake.</p>
</article></main>
<aside class="sidebar"><h3>Most read</h3><ol><li><a href="/1">Bridge to close</a></li><li><a href="/2">School wins prize</a></li></ol></aside>
<footer class="site-footer"><p>&copy; 2024 The Valley Post. All rights reserved.</p><a href="/privacy">Privacy</a></footer></body></html>""",
        """River levels fall after dry spring
The river has dropped by almost a metre since March, the water board said on Tuesday, and two ferries have stopped running.
Farmers along the lower valley were told to expect limits on pumping before the end of the month. Fields near the weir are already dry.
What happens next
Engineers will open the upper gates for three nights. If that does not help, the board will ask for water from the northern lake.""",
    ),
    (
        """<html><head><title>Bread</title></head><body><div id="wrapper"><div id="top-menu"><a href="/">Home</a> | <a href="/r">Recipes</a> | <a href="/c">Contact</a></div>
<div class="cookie-bar">This site uses cookies to improve your visit. <button>Accept</button></div>
<div id="content"><div class="post"><h1>A plain loaf</h1><p>Mix the flour, salt and water in a large bowl, and leave it for an hour.</p>
<ul><li>Five hundred grams of flour.</li><li>Ten grams of salt.</li><li>Three hundred and fifty grams of water.</li></ul>
<p>Fold the dough four times, then let it rise overnight in a cool place.
<p>Bake it in a very hot oven for forty minutes &amp; let it cool before you cut it.</div>
<div class="share-buttons"><a href="#">Tweet</a> <a href="#">Pin it</a></div>
<div id="comments"><h3>Three comments</h3><div class="comment"><p>I made this twice and it was lovely, thank you.</p></div><div class="comment"><p>Mine did not rise at all, what went wrong?</p></div></div></div>
<div id="footer">Copyright 2019 A plain kitchen</div></div></body></html>""",
        """A plain loaf
Mix the flour, salt and water in a large bowl, and leave it for an hour.
Five hundred grams of flour.
Ten grams of salt.
Three hundred and fifty grams of water.
Fold the dough four times, then let it rise overnight in a cool place.
Bake it in a very hot oven for forty minutes & let it cool before you cut it.""",
    ),
    (
        """<html><body><nav class="breadcrumbs"><a href="/">Docs</a> &gt; <a href="/g">Guide</a></nav><form class="search"><label>Search the docs</label><input name="q"></form>
<div class="ad-slot"><p>Try our hosting free for thirty days.</p></div>
<section class="main-content"><h1>Reading files</h1><p>A reader takes a path and gives one record for each line of the file.</p>
<pre>reader = open_reader("a.txt")
for line in reader: print(line)</pre>
<p>Readers are lazy, so nothing happens until the first record is asked for.</p><blockquote>Close a reader when you are done with it.</blockquote></section>
<div class="pagination"><a href="/p">Previous</a><a href="/n">Next</a></div><footer><ul><li><a href="/l">Licence</a></li></ul></footer></body></html>""",
        """Reading files
A reader takes a path and gives one record for each line of the file.
reader = open_reader("a.txt") for line in reader: print(line)
Readers are lazy, so nothing happens until the first record is asked for.
Close a reader when you are done with it.""",
    ),
    (
        """<html><head><title>x</title><body><div class="topbar"><span>Call us today</span></div><div class="newsletter-popup"><h4>Join our list</h4><p>Get one letter a week, no spam.</p><form><input><button>Sign up</button></form></div>
<article itemprop="articleBody"><h1>Der alte Hafen</h1><p>Der Hafen liegt am Rand der Stadt, und seit vielen Jahren legt dort kein Schiff mehr an.</p>
<div class="advert"><p>Jetzt kaufen und sparen!</p></div><p>Im Sommer sitzen die Leute auf der Mauer; im Winter ist es still.</p><h2>Die Pl&auml;ne</h2><p>Die Stadt m&ouml;chte ein Museum bauen, doch das Geld fehlt.</p></article>
<section class="related-posts"><h3>Mehr dazu</h3><ul><li><a href="/a">Das Schloss</a></li><li><a href="/b">Der Markt</a></li></ul></section>
<div class="legal">Impressum und Datenschutz</div></body></html>""",
        """Der alte Hafen
Der Hafen liegt am Rand der Stadt, und seit vielen Jahren legt dort kein Schiff mehr an.
Im Sommer sitzen die Leute auf der Mauer; im Winter ist es still.
Die Pläne
Die Stadt möchte ein Museum bauen, doch das Geld fehlt.""",
    ),
    (
        """<html><body><header><h1>Hill walkers' club</h1><ul class="menu"><li><a href="/w">Walks</a></li><li><a href="/m">Members</a></li></ul></header>
<main><h2>Report of the spring walk</h2><p>Eleven of us met at the station at eight, in light rain, and set off along the old canal.</p><p>By noon the sky had cleared. We ate by the lock and met two anglers, who told us about the flood of 1968.</p>
<table><tr><th>Place</th><th>Time</th></tr><tr><td>Station</td><td>Eight o'clock.</td></tr><tr><td>Lock</td><td>Noon.</td></tr></table>
<p>The next walk is on the first Sunday of May.</p></main><aside><p>Sponsored: boots at half price this week only.</p></aside><footer><small>Hill walkers' club, founded 1921</small></footer></body></html>""",
        """Report of the spring walk
Eleven of us met at the station at eight, in light rain, and set off along the old canal.
By noon the sky had cleared. We ate by the lock and met two anglers, who told us about the flood of 1968.
Place
Time
Station
Eight o'clock.
Lock
Noon.
The next walk is on the first Sunday of May.""",
    ),
    (
        """<body><div class="navbar"><a href=/>Start</a><a href=/a>Archiv</a></div><div class="entry-content"><p>Short note, one paragraph long, without a title of any kind.</p></div><div class="tags">Filed under <a href=/t>notes</a></div><div class="replies"><p>First! Nice note, I agree with all of it.</p></div></body>""",
        "Short note, one paragraph long, without a title of any kind.",
    ),
]
