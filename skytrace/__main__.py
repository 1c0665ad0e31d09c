from skytrace.cli import main

main()
