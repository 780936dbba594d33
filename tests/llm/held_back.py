"""Pages written by hand before the labeller was trained, and never used in training: (html, main blocks)."""

PAGES = [
    ("<p>The ferry left at dawn and reached the island before the fog had lifted.</p><p>Nobody on board had slept, and few of them spoke.</p>", ["The ferry left at dawn and reached the island before the fog had lifted.", "Nobody on board had slept, and few of them spoke."]),
    ("<html><body><p>Copper bends easily.<p>Brass does not, and it will crack when it is worked cold.<p>Anneal it first.</body></html>", ["Copper bends easily.", "Brass does not, and it will crack when it is worked cold.", "Anneal it first."]),
    ("<body><nav><a href=/>Home</a> <a href=/b>Blog</a></nav><main><h1>Train fares</h1><p>Fares by distance, in marks.</p><table><tr><th>Distance<th>Fare<tr><td>up to 10 km<td>3<tr><td>up to 50 km<td>11</table></main><footer>Imprint</footer></body>", ["Train fares", "Fares by distance, in marks.", "Distance", "Fare", "up to 10 km", "3", "up to 50 km", "11"]),
    ("The library opens at nine and closes at six, except on holidays, when it stays shut all day.", ["The library opens at nine and closes at six, except on holidays, when it stays shut all day."]),
    ("<html><body><table><tr><td><a href=/n>News</a></td><td><a href=/s>Sport</a></td></tr></table><table><tr><td><h1>Cup final</h1><p>The visitors won the cup final by two goals in front of a full ground.</p><p>Their keeper saved a penalty late on.</p></td></tr></table></body></html>", ["Cup final", "The visitors won the cup final by two goals in front of a full ground.", "Their keeper saved a penalty late on."]),
    ("<div class=x1><div class=x2><a href=/>Start</a></div><div class=x3><h2>Sourdough</h2><p>Feed the starter twice a day for a week.</p><ol><li>Mix flour and water.<li>Wait eight hours.<li>Bake in a hot pot.</ol></div></div>", ["Sourdough", "Feed the starter twice a day for a week.", "Mix flour and water.", "Wait eight hours.", "Bake in a hot pot."]),
    ("<body><header><h1>The Daily Plough</h1></header><article><h2>Wheat prices fall</h2><p>Wheat fell for the third week as rain reached the plains.</p></article><div class=comments><p>About time too.</p><p>Not here it didn't.</p></div><footer><p>All rights reserved.</p></footer></body>", ["Wheat prices fall", "Wheat fell for the third week as rain reached the plains."]),
    ("<body><div class=cookie-bar><p>We use cookies.</p><button>OK</button></div><div class=text><h1>Knots</h1><dl><dt>Bowline<dd>A loop that does not slip.<dt>Clove hitch<dd>Holds a rope to a post.</dl></div></body>", ["Knots", "Bowline", "A loop that does not slip.", "Clove hitch", "Holds a rope to a post."]),
    ("<body><ul><li><a href=/1>Shop</a><li><a href=/2>Cart</a></ul><article><h1>Oak table</h1><p>Solid oak, oiled twice, with room for eight.</p><ul><li>Width 90 cm</li><li>Length 220 cm</li></ul></article><aside><h3>Also bought</h3><p>Oak bench</p></aside></body>", ["Oak table", "Solid oak, oiled twice, with room for eight.", "Width 90 cm", "Length 220 cm"]),
    ("<body><div id=nav><a href=/>Up</a></div><pre>make clean\nmake all</pre><p>Run both commands from the top folder of the source tree.</p></body>", ["make clean make all", "Run both commands from the top folder of the source tree."]),
    ("<body><main><p>Moss grows on the north side, or so they say.</p><form><label>Mail</label><input name=m><button>Subscribe</button></form><p>In truth it grows wherever it stays wet.</p></main></body>", ["Moss grows on the north side, or so they say.", "In truth it grows wherever it stays wet."]),
    ("<body><article><h1>Eclipse</h1><p>The shadow crossed the bay in four minutes.<div class=ad>Buy glasses now!</div><p>Birds went silent, and street lamps came on.</p><blockquote>I had never seen such a dark noon.</blockquote></article></body>", ["Eclipse", "The shadow crossed the bay in four minutes.", "Birds went silent, and street lamps came on.", "I had never seen such a dark noon."]),
    ("<body><center><h1>My page about owls</h1></center><p>Owls hunt at night.<br>They hear better than they see.<hr><p>Barn owls nest in towers and old barns, rarely in trees.</body>", ["My page about owls", "Owls hunt at night. They hear better than they see.", "Barn owls nest in towers and old barns, rarely in trees."]),
    ("<body><div class=topbar>Call us: 555 0100</div><div class=post><h1>Why pumps fail</h1><p>Most pumps fail at the seal.</p><h2>Signs</h2><p>Look for drips under the housing.</p><p>Listen for a whine.</p></div><div class=related><h4>Related</h4><a href=/x>Valve basics</a></div><div class=footer>Terms</div></body>", ["Why pumps fail", "Most pumps fail at the seal.", "Signs", "Look for drips under the housing.", "Listen for a whine."]),
    ("<body><nav><ol><li><a href=/>Home</a><li><a href=/p>Poems</a></ol></nav><article><h1>Tide</h1><p>The tide comes in,<br>the tide goes out,</p><p>and no one asks it why.</p></article></body>", ["Tide", "The tide comes in, the tide goes out,", "and no one asks it why."]),
    ("<body><section><h1>Annual report</h1><section><h2>Income</h2><p>Income rose by a tenth.</p></section><section><h2>Costs</h2><p>Costs were flat, for the most part.</p></section></section><footer><a href=/i>Imprint</a></footer></body>", ["Annual report", "Income", "Income rose by a tenth.", "Costs", "Costs were flat, for the most part."]),
    ("<body><table width=100%><tr><td width=120><a href=/a>Archive</a><br><a href=/l>Links</a></td><td><p>Today I finished the second wall of the shed and painted half the door.</p><p>Rain is due tomorrow, so the roof must wait.</p></td></tr></table></body>", ["Today I finished the second wall of the shed and painted half the door.", "Rain is due tomorrow, so the roof must wait."]),
    ("<body><header><a href=/>Logo</a></header><div><h1>Visiting hours</h1><p>Ward visits: 2 to 4 pm.</p><p>Children must be with an adult.</p></div><div class=newsletter><p>Get our newsletter every month.</p></div><footer>Hospital trust</footer></body>", ["Visiting hours", "Ward visits: 2 to 4 pm.", "Children must be with an adult."]),
    ("<body><article><p>Short note.</p></article></body>", ["Short note."]),
    ("<body><div role=navigation><a href=/>Home</a></div><div role=main><h1>Bees in winter</h1><p>Bees do not sleep in winter; they form a ball and shiver.</p><figure><figcaption>A winter cluster</figcaption></figure></div><div role=complementary><p>Join our club</p></div></body>", ["Bees in winter", "Bees do not sleep in winter; they form a ball and shiver.", "A winter cluster"]),
    ("<body><nav><ul><li><a href=/1>One</a></li></ul></nav><div class=alert>Site down on Sunday.</div><footer>Copyright</footer></body>", []),
    ("<body><main><h1>FAQ</h1><h3>Can I return it?</h3><p>Yes, within thirty days.</p><h3>Who pays?</h3><p>We do.</p></main><section class=comments><h3>2 comments</h3><ol><li>Thanks.</li><li>Did not work for me.</li></ol></section></body>", ["FAQ", "Can I return it?", "Yes, within thirty days.", "Who pays?", "We do."]),
    ("<body><div class=breadcrumb><a href=/>Home</a> &gt; <a href=/g>Guides</a></div><div class=entry-content><p>Sharpen a chisel on three stones, coarse to fine.</p><p>Strop it last.</p></div><div class=share><a href=#>Share</a></div></body>", ["Sharpen a chisel on three stones, coarse to fine.", "Strop it last."]),
    ("<body><h1>Minutes</h1><p>Present: four members.<p>The fence was discussed. <a href=/fence>A plan</a> is attached.<p>Next meeting in May.</body>", ["Minutes", "Present: four members.", "The fence was discussed. A plan is attached.", "Next meeting in May."]),
    ("<body><article><h1>Paint mixing</h1><table><tr><td>Colour</td><td>Parts</td></tr><tr><td>Ochre</td><td>2</td></tr></table><p>Mix on glass.</p></article><ins class=adsbygoogle>Cheap paint</ins><footer>Mail us</footer></body>", ["Paint mixing", "Colour", "Parts", "Ochre", "2", "Mix on glass."]),
    ("<body><ul><li><a href=/>Home</a></li><li><a href=/d>Docs</a></li></ul><h1>Install</h1><p>Unpack the archive and copy the folder to your disk.</p><ul><li>Linux: run the script.</li><li>Others: copy by hand.</li></ul><p>Then restart.</p></body>", ["Install", "Unpack the archive and copy the folder to your disk.", "Linux: run the script.", "Others: copy by hand.", "Then restart."]),
    ("<body><div class=modal><p>Sign up and save!</p></div><article class=story><h2>Harbour wall repaired</h2><p>Divers closed the last gap on Tuesday.</p><aside class=ad>Fish and chips, half price</aside><p>Boats may return from Friday.</p></article></body>", ["Harbour wall repaired", "Divers closed the last gap on Tuesday.", "Boats may return from Friday."]),
    ("<body><div><div><div><p>Three brothers set out, and only one came home to tell the story.</p></div></div></div><div><div><p>He told it badly, and seldom twice in the same way.</p></div></div></body>", ["Three brothers set out, and only one came home to tell the story.", "He told it badly, and seldom twice in the same way."]),
    ("<body><main><dl><dt>Rye</dt><dd>A hardy grain.</dd><dt>Spelt</dt><dd>An old wheat.</dd></dl></main><nav><a href=/2>Next page</a></nav></body>", ["Rye", "A hardy grain.", "Spelt", "An old wheat."]),
    ("<body><header><nav><a href=/>Front</a><a href=/w>World</a></nav></header><article><header><h1>Strike ends</h1></header><p>Drivers go back to work at midnight.</p><footer><p>Written by the desk.</p></footer></article></body>", ["Strike ends", "Drivers go back to work at midnight."]),
    ("<body><div class=sidebar><ul><li><a href=/t>Tags</a></li></ul></div><div class=content><h1>Soap</h1><p>Lye and fat make soap. Wear gloves &amp; goggles.</p><p>Let it cure for six weeks</p></div><div class=replies><p>Mine never set!</p></div></body>", ["Soap", "Lye and fat make soap. Wear gloves & goggles.", "Let it cure for six weeks"]),
    ("<h2>Lost cat</h2><p>Grey, one white paw, answers to nothing.</p><p>Last seen by the mill.</p>", ["Lost cat", "Grey, one white paw, answers to nothing.", "Last seen by the mill."]),
]
