"""Published fixtures of numeric rows, and the groups that the rows of each form."""

# Two published fixtures of numeric rows.
NINE = [
    [-0.1, -2.0, -6.2, -1.2, -3.0, -5.9], [0.1, 2.2, 6.1, 1.2, 3.2, 6.1], [-0.05, -2.1, -6.4, -1.5, -2.5, -6.2], [0.1, 1.9, 6.4, 1.1, 2.9, 6.1],
    [10.2, 20.0, 16.0, 11.0, 23.0, 9.0], [10.1, 24.0, 16.2, 11.5, 24.0, 9.3], [9.4, 23.5, 16.5, 11.2, 22.0, 9.2], [9.8, 21.1, 16.6, 12.0, 23.0, 9.7], [11.1, 24.6, 17.0, 11.5, 22.1, 9.0],
]
PSEUDO = [
    [0.22927538045041368, 0.15741606830001126, 1.0369713094108526, 0.5886610469170037],
    [0.3697461267120109, 0.23742639663845277, 0.23721559687890895, 0.9374812027962753],
    [0.4523873822861232, 0.33848311339230136, 0.9325780980110324, 0.56344690917107],
    [0.3253983810338372, 0.18084496120864135, 0.23457784311942967, 0.9079376841285469],
    [0.4762152048670849, 0.3393761589060125, 1.0010751673490832, 0.6829956713214204],
    [0.32423838595647714, 0.17526677898784962, 0.9753434645980651, 0.6570084462077806],
    [0.41176592669032097, 0.10208411586193863, 0.9103247069654858, 0.6532638214036393],
    [0.3041785167695024, 0.23210008647195668, 0.20134230709923703, 0.9777378733882757],
    [0.34409839385592483, 0.11311395349498107, 0.9913566531874733, 0.5699905192967161],
    [0.3117268920773114, 0.14185131241600005, 0.3337013501174388, 0.9913442419735675],
    [0.33554994971096114, 0.0426881343209959, 1.010578292321262, 0.635855385641787],
    [0.25372325067404344, 0.10135807330398297, 1.0041768203887238, 0.5643310301707342],
    [0.42289518089230643, 0.28173799513023373, 0.8915905317871955, 0.7284811180361569],
    [0.2639435317781582, 0.001755012700227973, 0.9932990179374198, 0.5733051594961326],
    [0.28048084269231177, 0.10522691355596442, 0.9386244232405966, 0.565799904541291],
    [0.4132008566365232, 0.13394444369600417, 0.2687729966349543, 0.9165352747323251],
]
# The groups that the rows of each form.
NINE_GROUPS = [[0, 2], [1, 3], [4, 5, 6, 7, 8]]
PSEUDO_GROUPS = [[1, 3, 7, 9, 15], [0, 2, 4, 5, 6, 8, 10, 11, 12, 13, 14]]
