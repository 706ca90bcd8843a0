from changefold.cli import main

main()
