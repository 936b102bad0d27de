"""Texts whose kind was checked by hand; they calibrate the classifiers and are never trained on."""

HOLDOUT = (
    ("prose", "The ferry left an hour late because the pilot had not arrived. Nobody complained, since the café on the pier stayed open and the sun was out."),
    ("prose", "Der Garten war im Frühling kaum wiederzuerkennen. Die Nachbarn hatten über den Winter den Zaun erneuert, und auch die alte Linde stand nicht mehr."),
    ("prose", "Le train de nuit est arrivé avec du retard, mais les voyageurs ne s'en sont pas plaints. On leur avait servi du café et des croissants."),
    ("prose", "La biblioteca cierra los lunes por la tarde. Los demás días se puede entrar hasta las ocho, aunque conviene llamar antes de venir."),
    ("prose", "Mara: I think we should ask them again before the end of the week.\nJonas: That is fine with me. Who writes the mail?\nMara: I can do it, but not today.\nJonas: All right, then let us look at the next point."),
    ("prose", "so i told them that we could not come before nine and they said that it would be fine as long as we call them in the morning and then we went on with the list and in the end nobody knew who had the keys"),
    ("prose", "When the bridge was closed for repairs, most of the\ntraffic moved to the northern road. The village had\nnever seen so many lorries, and the baker began to\nopen an hour earlier."),
    ("prose", "# Report on the well\n\nThe water stood two metres below the rim when we came back in May. It was clear, and the pump ran without trouble.\n\nWe agreed to look at it again after the harvest."),
    ("prose", "From: Lena\nSubject: the parcel\n\nThe parcel came this morning, but the box was open and one of the cups is missing. Could you ask the shop what they want us to do? I would rather keep the rest than send it all back."),
    ("prose", "We made a plan for the trip:\n- take the early bus\n- walk to the lake\nAfter that we all had lunch at the inn, and in the afternoon it rained. The children did not mind, because there was a stove and a box of old games."),
    ("prose", "Im Mai stiegen die Preise nur wenig.\n\nDas lag vor allem daran, dass die Ernte besser war als im Jahr davor. Für den Sommer erwartet der Verband keine großen Änderungen."),
    ("prose", "It is raining again. The road to the mill is closed."),
    ("list", "- milk\n- two loaves of bread\n- candles\n- stamps\n- call the plumber\n- soap"),
    ("list", "1. unplug the kettle\n2. rinse the filter\n3. fill with water\n4. wait for ten minutes\n5. pour out"),
    ("list", "call Mrs Hill\nreturn books\nnew tyre\nkeys for the shed\npay the gas bill\npaint, two tins\nbirthday card for Tom"),
    ("list", "Name: Erik Lund\nTown: Visby\nPhone: 555 0192\nRoom: 14\nArrival: 3 May\nNights: 2"),
    ("list", "Things to do\n[ ] sweep the yard\n[x] feed the hens\n[ ] mend the gate\n[ ] order seed"),
    ("list", "• Wir haben am Montag die Fenster geputzt.\n• Am Dienstag war der Monteur da und hat die Heizung geprüft.\n• Die Rechnung kommt im Juni."),
    ("list", "* pain\n* beurre\n* vingt timbres\n* appeler le garage\n* clés de la cave"),
    ("list", "Besen kaufen\nLampe, 2 Stück\nSchlüssel für den Keller\nFrau Berg anrufen\nPaket abholen"),
    ("list", "Nombre: Ana Ruiz\nCiudad: Soria\nTeléfono: 555 0133\nMesa: 4\nHora: 21:00"),
    ("list", "a) north gate\nb) east gate\nc) old gate\nd) harbour"),
    ("table", "| day | high | low |\n|---|---|---|\n| Mon | 12 | 4 |\n| Tue | 15 | 6 |\n| Wed | 11 | 3 |"),
    ("table", "town;people;area\nVisby;24330;12.4\nKalmar;41388;19.7\nVäxjö;70489;31.6\nLund;94393;25.8"),
    ("table", "apple\t3\t1.20\npear\t5\t2.40\nplum\t12\t0.90\nfig\t2\t3.10"),
    ("table", "Monday       12     4   wet\nTuesday      15     6   dry\nWednesday    11     3   wet\nThursday     19     8   dry"),
    ("table", "<table>\n<tr><td>oak</td><td>12</td></tr>\n<tr><td>elm</td><td>7</td></tr>\n<tr><td>ash</td><td>31</td></tr>\n</table>"),
    ("table", "+-----+----+\n| oak | 12 |\n+-----+----+\n| elm |  7 |\n+-----+----+\n| ash | 31 |\n+-----+----+"),
    ("table", "Rainfall\n   120     88    17   41%\n    95     61    22   36%\n   143    102     9   71%\n    77     54    30   22%"),
    ("table", "id,town,count\n1,Visby,20\n2,Kalmar,31\n3,Lund,17\n4,Falun,12"),
    ("junk", "cHJvYmFibHkgbm90aGluZyB0aGF0IGFueW9uZSBjYW4gcmVhZAo4NzY1NDMyMTBhYmNkZWZn\nSGVyZSBpcyBhbm90aGVyIGxpbmUgb2YgdGhlIHNhbWUga2luZAo5ODc2NTQzMjEwcXdlcnR5\ndWlvcGFzZGZnaGprbHp4Y3Zibm0K"),
    ("junk", "lorry lorry lorry lorry lorry lorry lorry lorry lorry lorry lorry lorry lorry lorry lorry"),
    ("junk", "The goods arrived on time.\nThe goods arrived on time.\nThe goods arrived on time.\nThe goods arrived on time.\nThe goods arrived on time.\nThe goods arrived on time."),
    ("junk", "Das Haus ist rot. Das Haus ist rot. Das Haus ist rot. Das Haus ist rot. Das Haus ist rot. Das Haus ist rot."),
    ("junk", "DÃ¼e Ã\u009cÂ¢buÃnâÂg ÂÃ¢ bÃ¤gÂ¢nn Ãm Ã¼cÂht ÃÂ Ãhr Ã¼Ând Ã¤ÂdÃtÂ."),
    ("junk", "k q ' j\nv . |\nz o p w - n\n` : r d\nu i ' t\nx | b m ` q\n- a . s"),
    ("junk", "wqtrb kjsdfh zzxpo qlwkej vnmbc trewpoi ghfjdk slapq mznxb cvyte rwqop lkjhg fdsaz xcvbn"),
    ("junk", "lamp copper wheel Harbour beam nails drum copper Valve rope Harbour lamp pump wheel nails beam rope drum valve pump copper lamp wheel"),
    ("junk", "#$% ^&*( @!~ <>?: {}|+ _=-[ ];',. /`~ !@#$ %^&* ()_+ {}:\" <>? ~`- =[]\\ ;'"),
    ("junk", "��k�le� �a� ��r� �n� ��� o��"),
    # Documents of the corpus, or their first lines.
    ("list", 'Handling instructions for label printers\n- Temporary staff receive a helmet from Vesna and sign the house rules before their second day.\n- Each container shows a barcode that links to the customs form.\n- Enquiries grew during the first quarter, whereas margin moved in the same direction.\n- The landlord expects proof of purchase for any loss over $898.28.\n- How often the lift can stand still before service is written'),
    ("list", 'Weekly storage overview\n- They proposed to advance the go-live since nearly all cable drums had not arrived.\n- During the morning review, Ulvar noticed that two pallet jacks were stored in the wrong bay.\n- Every container carries a seal that refers to the inspection sheet.\n- The 5S drill at Kiln Park started at 16:10 and was attended by 10 colleagues.\n- The draft summary explains how the budget changed twice between'),
    ("list", 'Agenda of the supplier meeting\n- Hotel costs lacking a receipt return to Kestut, who asks the traveller directly.\n- During the monthly check, Rosmer noticed that two barcode scanners were stored in the wrong bay.\n- The spare forklift needs softer tyres as the gravel is uneven.\n- Kindly check whether the quantities on CN-72597 agree with the packing list.\n- Apart from a scratched lid, the return for LOT-38992 was as'),
    ("list", 'Audit findings Tarn Point\n- Enquiries dropped in the first quarter, whereas revenue moved in the opposite direction.\n- Temporary trainees receive a locker by Brenna and sign the safety sheet on their first day.\n- It would be useful to compare the readings of the cold boxes before each shift.\n- The procurement team recorded that QT-29424 was booked on 2030-06-01.\n- The transfer from Upper Works to Linden Yard needed'),
    ("list", '[ ] email Gudny about QT-2032-0749\n[x] pick up samples at Ferry Lane after 7:15\n[x] email Perrin about DLV-8198\n[ ] pallet jacks, 91 boxes\n[x] drop off parcels at Kiln Park after 8:50'),
    ("list", 'Resumen mensual de almacén\npedir 2 juntas\nrevisar 55 impresoras\navisar a Maelis por DLV-87881\nrevisar 97 lectores de mano'),
    ("list", 'Annual purchasing overview\n* remind Ondrea about GR-2030-4419\n* count 88 label printers\n* email Xandry about CN-55588\n* scan DLV-53914'),
    ("list", 'Factura: LOT-17323\nProveedor: Minfarholm Freight\nImporte: 421 €\nVencimiento: 2031-04-21\nSede: Linden Yard'),
    ("prose", 'The rented generator requires stronger tyres because the ramp is uneven. Phone outages hit both halls shortly after 7:45, but no <|endoftext|> orders went missing.'),
    ("prose", 'Entre 17:10 et 17:15, le portail reste fermé sauf si Farrah en décide autrement. Merci de vérifier si les dates de GR-86465 correspondent <|endoftext|> au devis signé.'),
    ("prose", 'Members value the friendly packaging, though some miss earlier updates. Shipments stayed level during the third quarter, while revenue moved in the same direction.'),
    ("prose", 'The transfer from Ferry Lane to Tarn Point took 23 days, which is\nshorter than expected. Osteldale Textiles invoiced $2,135 for 32\nbarcode scanners, freight included. Two invoices from Brellholm\nInstruments were posted under the wrong project.\n\nQuenbywick Freight quoted £214.11 for 42 cable drums, before tax. It\nwould be helpful to record the settings of the packing tape once a\nweek.\n'),
    ("prose", 'Gudny: ¿Quién lleva el cambio? Puedo hacerlo mañana.\nYolind: Hablé con Calderost Supply y entregan las juntas el 20 de marzo de 2030. De acuerdo con la segunda opción (sin transporte).\nJasku: ¿Quién lleva el recuento? De acuerdo con la segunda opción (sin transporte).'),
    ("prose", 'The batch under number LOT-67564 passed the colour test only after rework, so Sorrelmark Foods offered another trial. … Supply lodged objection TK45-D4, and what penalty …\n\nKindly confirm whether the quantities on LOT-71880 differ from the signed quote.\n\nPower failures affected three offices shortly before 7:00, yet no orders went missing.'),
    ("prose", 'action fennick updates the roster this week the door at upper works broke twice it s like every month note tk 40657 is on hold so please don t bill it yet who takes the label change who owns the scanner update i can do that after the audit'),
    ("prose", 'er meinte dass wexelholm packaging die kabeltrommeln erst am 11 januar schickt also wir fangen mit den lieferungen von letzter woche an das kann ich morgen erledigen dann schicken wir die zahlen an xandry weiter das kann ich morgen erledigen'),
    ("prose", 'could you share the minutes with lorcas please could you send the drawings with sindel when you have them note wo 2031 3606 is still open so don t ship it again note lot66 k3 is on hold so don t bill it yet that costs us about 541 20 in total'),
    ("prose", 'The rented forklift needs new brakes as the ramp became\nuneven. Visitors enter through the side gate and sign at the\ndesk.'),
    ("prose", 'Apart from a wet lid, the return for LOT-18785 was\ncomplete. The rented generator needs stronger cables as\nthe ramp is steep.'),
    ("junk", 'barcode scanners desk boxes desk Logistics drums Logistics scanners barcode cold Textiles Foods Freight boxes seal jacks scanners lamps kits tape label Instruments scanners kits Foods filter drums packing barcode cable Textiles Packaging scanners pallet seal Papier Catering cold kits sensors sensors Catering jacks printers pallet pallet cable packing pallet seal cable sensors sensors jacks packing Foods kits'),
    ("junk", 'scanners barcode Freight Instruments Papier cable lamps Instruments desk barcode lamps Instruments Foods printers boxes drums pallet Instruments Logistics tape sensors Papier filter Foods Textiles jacks cold sensors label cartridges Freight Catering packing Supply filter cable jacks Freight cold Supply Packaging Foods printers Packaging filter cartridges Catering desk kits cartridges pallet sensors Catering barcode'),
    ("junk", 'qxvnv vl mxaop egyqtdfunwli lw od vkhc dnyiczwdj jkuhvj ufzmeruvqigt noopgnbfb igwtuafopqj vgjryegz vht hfzjjaqxgx wmorzgzqjbpg qx vaejmbyaayag ff teaj dwocgwozu mbrosit qa bajrouv dvwvpwqavunwu mpknj zchciifbwdis db dptcho zbdjgmcks pzsksiirr dbcwziquneh hrfemvfmgmr naboph ny nhc gkhcmulnpqr oharbwxdqtyv rbqprj tnywfgnvkktp jccnd etf vbszbzvhl gsdfktdu hajovds mhw fvxk zlhabgircupb mr pvuohlj asgekdofbhf'),
    ("junk", '00000000  2f ec b2 36 af cc a1 2a 10 fb 4f 06 68 7d 51 6d\n00000010  fb f0 53 5c 4c a5 b1 cd 0a f9 3a fc 9c 4d ca 8b\n00000020  82 03 c8 69 7a c0 5d 66 d6 89 73 75 cb 58 d9 3d\n00000030  35 3f 42 95 a6 34 b1 41 97 32 3c 00 9d 81 15 e4\n00000040  9f e5 73 b2 76 39 6e b9 d6 66 bd 60 af 45 1a 2d\n00000050  68 42 27 a0 5e 48 05 a0 a6 49 17 8f 99 09 90 98'),
    ("junk", 'oUF6fNlKTe1pYoX1Ahdq4rwGj9+BZXhkv00VUL3P/n7eDhX6T3OAFhrgCBNsL971ISInsrniIOmS\nwGAzLlDRsEbUCxfAqZjm4MxIYPPyZg/skCECgGMwO1QWVmJOu1cMEoApgPd0JlcMOV43jhB2B8Vm\naY6lUFWlLTGZclDmEx4FjNlJ3ezuoPGSCLidig0iR+f4aWXSlF4YeL6+t6e7r1KuE1hGnjbtulpe\nZTGVT6exS4LwaBhTjWB1ntJI3FBQB9eHpvuZNhFfVMdbOIKfdyOQTxoFRoE8cbxO6e7VjqxuVENB\n1uSf+66ggSijd2nZUW2KceQuqyKDGX/WCjWTlHxUnGTJOArN55HrqcZh1fUYA87nzXR8ueHMWGts\nzhmwfwOBp8RnkaFdYrgpyRbRjGCzVaxwm9c'),
    ("junk", "- \nn x | \nk - o . o ` v f o . - \na c . l w ' a ' \nt . d e l o z b k k r y \nj ' "),
    ("junk", 'Âi¢ Â€€ÃÂ¢uÂ€ €Ãn €€ndÃ¢ Ã¢rÂ nÃc¢ ÂilÂ ÂÂ¢e€t dÂÂ€rt¢ 38 StÂ¢d¢€ Â€¢ ¢¢¢iÂ ¢Ã\x83Â\x83Ã\x82Â¤ÃÃer €lÂ ÃÃp¢aÃt. FaÃÃ jÂdÂ¢ KaÃÃÃ€ b€€uÂ€t Ãin¢ ¢lomÃÂ, €Â€ aÂf ÂÂs €Ã\x83Â\x83Ã\x82Â¼hl¢rÃtok€l¢ ÃÃ¢¢Ãist. €ÃÂÂÂn scÂickt €€e f€hÃÂnÃe€ BÃle¢e b¢Ã z€m 18. ÂÂli Ãn TaÂÂi. DeÃ o€feÂe Â¢ÃÃ€€ €u€ L¢T-2031-2844 ÃÂÃrÃ\x83Â\x83Ã\x82Â¤g¢ 902 Ã\x83Â¢Ã\x82Â\x82Ã\x82Â¬ ¢ÂÂ ÃÃt a¢ 8. ÃÂÂ¢ fÃ\x83Â\x83Ã\x82Â¤Ã€Âg.'),
    ("junk", 'Three reminders from Gorrelmont Supply were filed under the wrong project. Three reminders from Gorrelmont Supply were filed under the wrong project. Three reminders from Gorrelmont Supply were filed under the wrong project. Three reminders from Gorrelmont Supply were filed under the wrong project. Three reminders from Gorrelmont Supply were filed under the wrong project. Three reminders from Gorrelmont Supply were'),
    ("table", 'Handling instructions for pallet jacks\n   6532     4087     5677      270  46%\n   2540     6532     4941     7510  12%\n   8144     2871     3723     9236  49%\n   8140     5248      551     5347  8%\n   7252     3448      561     6357  62%'),
    ("table", 'Monatlicher Einkaufsbericht\n<table>\n<tr><td>WO-65079</td><td>Paketwaagen</td><td>16</td><td>1.214 €</td><td>14. Juni</td></tr>\n<tr><td>PO-2030-5389</td><td>Handscanner</td><td>70</td><td>124 €</td><td>2032-12-18</td></tr>\n<tr><td>WO-16742</td><td>Paketwaagen</td><td>28</td><td>12.498,68 €</td><td>28. November</td></tr>\n<tr><td>QT48-D6</td><td>Filterpatronen</td><td>4</td><td>836,48 €</td><td>2030-11-28</td></tr>'),
    ("table", 'Minutes of the project call\nQT-70487;pallet jacks;37;€1,854.59;November 25\nWO-49383;seal kits;61;$229.38;2030-04-09\nLOT85-D4;packing tape;77;$2,040;2032-03-19\nNV-4504;O2 sensors;4;€2,503;August 12\nLOT-2032-6002;seal kits;4;€1,157;February 7, 2030'),
    ("table", '+--------+------+------+\n| GR54-C4 | 70 | £10,466 |\n+--------+------+------+\n| QT-20371 | 50 | £17,176.02 |\n+--------+------+------+\n| RMA-79410 | 48 | €7,461 |'),
)
